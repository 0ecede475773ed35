"""Texts written for measuring the residue operator, none taken from the tables: (text, whether it is a case).

The first half of each list served while the rules were written, the second
was read only for the figure in the README.
"""

CASES = [
    # unfilled fields
    "Dear [Customer Name], thank you for your order.", "Hello ${user.name}, welcome back to the depot portal.", "Report for {{ unit|upper }} on {{ date }}", "Hi {{first_name}},\nyour visit is due on {{ visit.date | format('long') }}.",
    "Attn: <<Contact_Person>>, please confirm receipt.", "The vehicle %VEHICLE_ID% was inspected by %INSPECTOR%.", "Dear [Insert Name], your booking is confirmed.", "Subject: {SUBJECT}\nDear {NAME}, please find the result below.",
    "Your order #{order_number} has shipped.", "Kind regards,\n[Your Name]\n[Your Title]", "Name: <enter full name>\nDate: <enter date>", "Sehr geehrte Frau [Nachname], anbei der Bericht.", "Hej {{kundnamn}}, tack för din anmälan.",
    "{% block content %}{% endblock %} Door report", "<%= @user.email %> has been notified.", "Invoice @@INVOICE_NO@@ is due.", "Total: $$AMOUNT$$ payable now", "__COMPANY_NAME__ hereby confirms the inspection.", "Delivery to [Street Address], [City], [Postal Code].",
    "Dear Mr. [Last Name], we refer to your letter of [Date].",
    "Dear {{ customer.first_name | default('friend') }}, the door was repaired.", "Meeting at ${event.location} on ${event.date}.", "Signed by [Name of Engineer] on [Date of Signature]", "Good morning <<FirstName>> <<LastName>>,", "Account %ACCOUNT_NUMBER% was closed.",
    "[INSERT COMPANY LOGO HERE]\nAnnual report", "Please contact {support_email} for help.", "Dear [Recipient],\nwe hereby confirm the appointment.", "Lieber {{vorname}}, die Wartung ist abgeschlossen.", "Kund: [Fyll i namn]\nDatum: [Fyll i datum]",
    "Bitte wenden Sie sich an [Ansprechpartner eintragen].", "#{user} logged a complaint about seat #{seat}.", "The {{#if urgent}}urgent{{/if}} report of {{unit}}", "<% if report %> Report <% end %>", "Your code is @@CODE@@ and expires soon.", "Dear __FIRST_NAME__, welcome aboard.",
    "Prepared for: [Client Name]\nPrepared by: [Author Name]", "Hello [[name]], your ticket is open.", "We received your request on {date} and will answer by {deadline}.", "Vehicle: [Vehicle Number]\nFault: [Describe the fault]",
    # filler
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "XXX INSERT TITLE HERE XXX", "Add your text here.", "This is sample text. Replace it with your own.", "TODO: write the introduction", "Coming soon!", "Text goes here text goes here text goes here", "Your content here", "asdf asdf asdf asdf", "blah " * 60,
    "Placeholder paragraph, to be replaced before release.", "Insert description here", "Platzhaltertext", "Hier kommt später der Text.", "Exempeltext", "Description to follow.", "[TBD]", "Write something about the depot here.", "Dummy entry, please delete.", "Type your message here...",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip.", "Sample paragraph. Replace this with your own words.", "Put the summary here", "Content coming soon", "TBD - to be determined", "Test test test test", "qwerty qwerty qwerty", "bla bla bla bla", "This text is only a placeholder.", "Lägg till text här",
    "Text folgt.", "Beschreibung folgt in Kürze.", "Click to add text", "Enter text here", "Title goes here\nSubtitle goes here", "Lorem ipsum", "xxxxxx xxxx xxxxxxxx", "TODO add conclusion", "Summary: to be completed", "Här ska det stå en text.",
    # notices
    "Please turn on JavaScript in order to use the portal.", "You need to enable JavaScript to run this app.", "404 Not Found\nnginx/1.18.0", "Access Denied\nYou don't have permission to access this resource.", "502 Bad Gateway", "Service Temporarily Unavailable", "Sorry, this page isn't available.",
    "Your session has expired. Please log in again.", "Internal Server Error\nThe server encountered an internal error or misconfiguration and was unable to complete your request.", "This site can't be reached", "Oops! That page can't be found.", "JavaScript is disabled in your browser. Please enable JavaScript to proceed.",
    "Checking your browser before accessing the site. This process is automatic.", "An unexpected error has occurred. Please try again later.", "Die Seite wurde nicht gefunden.", "Zugriff verweigert", "Sidan kunde inte hittas.", "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "429 Too Many Requests", "This content is no longer available.",
    "We're sorry but this application doesn't work properly without JavaScript enabled.", "HTTP Error 503. The service is unavailable.", "403 Forbidden", "The page you requested could not be found. It may have been moved or deleted.", "Error establishing a database connection", "Gateway Timeout\nThe upstream server did not respond in time.",
    "To view this map, scripts must be allowed.", "Something went wrong. Reload the page or come back later.", "You are not authorized to view this document.", "Login required", "Fehler 500: Interner Serverfehler", "Sie haben keine Berechtigung, diese Seite aufzurufen.", "Du måste slå på JavaScript för att använda kartan.", "Tjänsten är inte tillgänglig just nu.",
    "Application error: a client-side exception has occurred", "The requested URL was not found on this server.", "Maintenance in progress, we will be back shortly.", "Request timed out", "noscript: this viewer relies on JavaScript", "HTTP Status 404 – Not Found\nApache Tomcat/9.0.37",
]

NOT_CASES = [
    "The report page showed a 404 error until the cache was cleared on Tuesday.", "Operators complained that JavaScript had to be enabled before the chart was drawn.", "The template exporter left {{unit}} unresolved; fixed in release 4.", "for (const k in rows) { total += `${k}`; }", "[INFO] door controller started", "<time> door 3 opened",
    "The driver reported that the door did not close.", "Access to the roof was denied by the yard master because of ice.", "def render(name):\n    return f\"Hello {name}\"", "Gateway replaced, error counter back to zero after the test drive.", "The service was unavailable for two hours while the pantograph was exchanged.", "2016-01-05 10:00:00 ERROR http.client: 503 Service Unavailable from depot server",
    "Text on the display was unreadable; the panel was replaced.", "We tested the test bench with a test load of three tonnes.", "Filler cap of the coolant tank was missing.", "The placeholder in the mail template was filled correctly after the update.", "export PATH=${HOME}/bin:$PATH", "Driver said: sorry, the page was not found in the manual.", "Check [Table 3] for the torque values.", "The lorem of the story is that nobody reads manuals.",
    "Page 404 of the manual describes the brake resistor.", "Session with the supplier expired without result; new meeting on Friday.", "cfg { timeout = 30; retries = 3 }", "The unit was not found at the depot because it had been moved to track 9.", "Permission to move the train was given at 10:05.", "if [ -z \"$1\" ]; then echo usage; fi", "[Door Control] replaced the relay, see sketch.", "Coming back soon from overhaul, unit 117 will run on line 4.", "The screen says 'Please enable JavaScript' since the update, customer informed.", "Add coolant here is written on the cap, but the label is gone.",
    "Login at the terminal was required again after the power loss.", "<entry level=\"WARN\">fan {speed} out of range</entry>", "We replaced the sample valve with a new one and ran the test again.", "Error 42 was seen twice; root cause is a loose connector.", "SELECT * FROM t WHERE id = :id", "The scripts of the test bench must be allowed to run as operator, see manual.", "Description of the fault: door leaf hits the frame.", "The text of the announcement was wrong, corrected in version 7.", "printf(\"%s: %d\\n\", name, n);", "To be determined by measurement: play of the coupling, value was 3 mm.",
]
