"""Small labelled table for private data in free text.

Each line of ``LINES`` is a labelled sentence: a slot in braces stands for an item of that kind (or,
for the last kinds, for text that is no item) and is filled by the rules below, so that every line
gives sentences whose labels are known.

Provenance: every sentence was written for this table, in eight languages, from what letters, forms,
tickets and talk about music usually say; none is taken from the documents the field is used on, and a
test holds that no fragment of a line occurs in them. Given names are usual ones of several countries or
made up, surnames, streets, towns and hosts are made up; number formats are the public ones of their
countries.
"""

from __future__ import annotations

import random

# Slots {name} {email} {phone} {identity} {address} are items; {song} {album} {band} {num} and so on are none.
LINES = r"""
{name} phoned this morning about the amplifier.
I spoke with {name} yesterday and we agreed on a price.
Dear {name},\nyour parcel left our depot on Friday.
Dear {name}, thank you for the quick payment!
Hello, {name} here again with a question about tape.
This message was left by {name}, please ring back on {phone}.
The petition was handed in by {name}, {name} and {name}.
Attendance: {name}, {name}, {name}, {name}.
Attendance: {name}, {name} and {name}. {band} opened the evening.
Votes came from {name} and {name}; {name} abstained.
Our treasurer is {name} and our secretary {name}.
Witness: {name}. Signed at {address}.
The minutes were taken by {name} ({phone}).
{name}, {name} and {name} carried the piano upstairs.
Between us, {name} and {name} never returned the microphones.
The winning bid was placed by {name} from {address}.
Invoice to: {name}, {address}.
Deliver to {name} at {address}, the bell is broken.
Deliver to {address}; if nobody opens, try {phone}.
Sender: {name}, {address}, {email}
Recipient: {name}\n{address}\n{phone}
The courier says {name} of {address} refused the package.
Customer {name} has moved to {address}.
He used to live at {address} until the flood.
We meet at {address} every second Sunday.
Rehearsal room: {address}. Key with {name}.
The estate of {name} sells all shellac discs.
An uncle of mine, {name}, repaired gramophones.
My sister {name} sings in the choir, write to her at {email}.
My colleague {name} can lend you a stylus, his mobile is {phone}.
The tenant upstairs, {name}, complained about the volume.
Whoever finds my wallet: {name}, {phone}.
Left behind on the train: a bag with a label saying {name}, {address}.
Caller gave the name {name} and the number {phone}.
You can text me at {phone} any time.
Fax {phone}, telephone {phone}.
Mobile: {phone}
Phone number of the buyer is {phone}.
Dial {phone} and let it ring twice.
WhatsApp {phone} works best.
Somebody published my phone {phone} here; moderators, delete it!
Her home line is {phone}, weekdays only.
For viewing call {phone} or write {email}.
Mail me: {email}
Write to {email} for the password.
E-mail {email} bounced twice this week.
New account registered with {email}, confirmation pending.
Send the invoice to {email}, not to {email}.
Newsletter subscribers: {email}, {email}, {email}
From: {name} <{email}>\nSubject: missing booklet
To: {email}\nCc: {email}
> On Sunday {name} <{email}> said:
The old mailbox {email} is closed; use {email} from now on.
My address is {email} and nothing else.
Submitted by {name} via {email}.
Bug filed by {name}, answer goes to {email}, urgent cases to {phone}.
Staff contact {name}, {email}, {phone}.
{name};{phone};{email};{address};{identity}
{name};{address};{phone};{email} {song} was cut from the set.
{name}\t{email}\t{phone}
{name},{email},{phone}
name={name}; mail={email}; tel={phone}
{"name": "{name}", "email": "{email}", "tel": "{phone}"}
{"owner": "{name}", "street": "{address}", "id": "{identity}"}
Lender: {name}. Due back: June. Tel. {phone}. Card {identity}.
Borrower {name}, identity document {identity}, deposit paid.
Member file: {name} | {address} | {phone} | {identity}
Member file: {name} | {address} | {phone} | {identity} {song} by {band} is overdue.
Insurance number {identity} belongs to {name}.
His social security number is {identity}, which nobody should see.
SSN: {identity}
NI number: {identity}
The form asks for a social security number; I wrote {identity}.
Taxpayer reference {identity} appears on the scan of the receipt.
TIN {identity}, issued to {name}.
Passport {identity} was photographed next to the record.
Travel document no. {identity}, holder {name}.
A residence permit numbered {identity} fell out of the gatefold.
Identity card {identity} expires soon.
My ID is {identity} and my phone is {phone}.
do delete {identity} from the picture, that is my identity number
Kind regards\n{name}
Best wishes,\n{name}\n{phone}
Yours sincerely,\n{name}\n{address}
Cheers, {name}
All the best from {name}
-- \n{name}\n{email}\n{phone}
Thanks to {name} for lending the master tape.
Photographs courtesy of {name}.
Proofread by {name}, typed by {name}.
Ask for {name} at the counter.
I bought the whole box from {name} in March.
The seller, {name}, lives at {address}.
{name} has paid, {name} has not.
{name} from the record fair sends greetings.
According to {name} the needle was new.
Hallo, hier spricht {name}, bitte um Rückruf unter {phone_de}.
Guten Tag {name}, Ihr Paket liegt bereit.
Guten Tag, mein Name ist {name}.
Gestern hat {name} die Kisten abgeholt.
Rechnung an {name}, {address_de}.
Lieferung nach {address_de}, zweiter Stock.
Treffpunkt ist {address_de}, jeden Freitag.
Ich bin umgezogen: {address_de}.
Unser Kassenwart {name} ist unter {phone_de} zu erreichen.
Telefon: {phone_de}
Ruf einfach {phone_de} an, abends ab acht.
Der Käufer {name} zahlt bar; {name} überweist.
Anfragen bitte an {email}.
E-Mail: {email}
Reisepass {identity}, gültig bis Mai.
Sozialversicherungsnummer {identity}, ausgestellt für {name}.
Ausweis {identity} bitte schwärzen.
Steuernummer {identity}, Inhaber {name}.
Herzliche Grüße\n{name}
Danke an {name} für die Leihgabe. {band} kommt im Herbst wieder.
Anwesend: {name}, {name} und {name}.
Bonjour, ici {name}, rappelez-moi au {phone_fr}.
Le vendeur s'appelle {name} et demeure {address_fr}.
Facture pour {name}, {address_fr}.
Livraison : {address_fr}.
Nous avons déménagé : {address_fr}.
Téléphone : {phone_fr}
Joindre {name} au {phone_fr} après le dîner.
Merci d'écrire à {email}.
Courriel : {email}
Passeport {identity}, titulaire {name}.
Mon numéro fiscal {identity} est visible sur la photo.
Titre de séjour n° {identity} trouvé dans la pochette.
Bien à vous,\n{name}
Étaient présents {name}, {name} et {name}. {song} a clos la soirée.
Hola, soy {name}, mi móvil es el {phone}.
Compré el lote a {name}, que vive en {address_es}.
Factura a nombre de {name}, {address_es}.
Nos vemos en {address_es} el sábado.
Teléfono: {phone}
Correo electrónico: {email}
Pasaporte {identity} a nombre de {name}.
NIE {identity}, por favor bórralo.
El número de la seguridad social {identity} sale en la foto.
Saludos cordiales,\n{name}
Gracias a {name} y a {name} por el préstamo.
Olá, fala {name}, telefone {phone}.
Entregar na {address_es}, ao cuidado de {name}.
Escreva para {email}, por favor.
Obrigado, {name}
Buongiorno, sono {name}, scrivetemi a {email}.
Здравствуйте, это {name}, мой телефон {phone}.
Связь через {email}, спросить {name}.
Спасибо, {name}
{x} {x} {name} {x} {x}.
{x} {name}, {x} {x}
{cap} {x} {x} {name}.
{cap} {name} {x} {x} {x}.
{x}: {name}; {x}: {x}
{x} {x} {song} {x} {x}.
{cap} {x} {song}, {x} {x}
{cap} {album} {x} {x} {song}.
{x} {x} {song} {x} {album} {x}
{song} {x} {x} {x}, {x} {x}.
{cap} {x} {cap} {x} {x} {cap}.
{cap} {cap} {x} {x} {x} {genre} {x}.
{x} {x} {genre} {x} {genre} {x}
{cap} {band} {x} {x} {band} {x} {song}
{cap} {x} {x} {email} {x} {x}.
{x} {email}, {x} {x}
{cap} {x} {x} {phone} {x} {x}.
{x} {phone}, {x} {x}
{cap} {x} {x} {address} {x} {x}.
{x} {address}. {cap} {x} {x} {x}
{cap} {x} {x} {address_de} {x} {x}.
{x} {address_de}. {cap} {x} {x} {x}
{cap} {x} {x} {address_fr} {x} {x}.
{x} {address_fr}. {cap} {x} {x} {x}
{cap} {x} {x} {address_es} {x} {x}.
{x} {address_es}. {cap} {x} {x} {x}
{x} {x} {n} {x} {x} {n} {cap}, {x} {n}
{cap} {x} {n}:{n} {x} {x}. {cap} {n} {x}
{x} {hex} {x} {num} {x} {n} {x}
{name};{email};{phone};{address}
{address};{name};{phone};{identity}
{identity};{name};{address};{email};{phone} {cap} {x} {x} {band}.
{name}; {phone}; {email}; {address} {cap} {x} {song}.
{address}; {phone}; card {identity}
{name}; {identity}; {phone}; {address}\n{song} {x} {x}
{phone};{address} {cap} {x} {x}
{phone}; {address}\n{band} {x} {x} {song}
{x} {x} {name} {x} {x} {x} {x}.
{x} {x} {x} {name}, {x} {x} {x} {x}
{cap} {x} {x} {x} {name} {x} {x} {address}.
{x} {name} {email} {x}
{x} {x} {name}, {address}, {x} {x} {phone}. {cap} {x}
{cap} {x} {name} ({email}), {x} {phone}.
{cap} {x} {x} {name} {x} {x} {x} {identity}. {cap} {x} {x}
{cap} {name}\n{x} {x} {x}
{cap} {name} {x} {name} {x} {x} {x}.
{cap} {x} {x} {name}.\n{cap} {x} {x} {song}.
{x} {email}. {cap} {x} {x}
{cap} {x} {x}, {x} {email}.
{x}: {email}\n{cap} {x} {x} {x}
{x} ({email}) {x} {x}
{x} ({phone}) {x} {x} {x}
{cap} {x} {x} ({phone}), {x}.
{x} {phone}. {cap} {x} {x}
{x}: {phone}\n{cap} {x}
{x} {phone} {x} {phone}, {x} {x} {x}.
{cap} {x} {x} {phone_de}. {cap} {x} {x}
{x} {x} {phone_de} {x} {x}
{cap} {x} {phone_fr} {x} {x}.
{x} {phone_fr}, {x}
{x} SSN {identity} {x} {x}
{cap} {x} SSN {identity}, {x} {x}.
{x} {x} insurance number {identity} {x} {x}
{x} insurance no. {identity}. {cap} {x} {x}
{x} tax number {identity}, {x} {x}
Tax ID {identity}; {x} {x} {x}
{x} {x} passport {identity} {x}
{x} passport number {x} {x} {x} {identity}. {cap}
{x} residence permit {identity}. {cap} {x}
{x} resident's card {identity} {x}
{x} ID {identity} {cap} {x} {x} {x} {x}
{x} identity {x} {identity} {x} {x}
{x} Ausweisnummer {x} {identity}. {cap} {x} {x}
Ausweisnummer: {identity}
{x} Personalausweis {identity} {x} {x}
{x} Steuer-ID {identity} {x}
{x} carte d'identité {identity} {x} {x}
{x} séjour {identity}, {x} {x}
{x} sécurité sociale {identity} {x} {x}
{x} DNI {identity} {x} {x} {phone}
{x} documento {identity}, {x}
{cap} {x} {ssn} {x} {x}.
{x} {ssn}, {x}
{cap} {x} Nummer {ssn}. {cap} {x} {x}
{x} die Nummer {ssn} {x} {x}.
{x} number {ssn} {x} {x}
{cap} {x} {x} number {ssn}. {cap} {x}
{x} numéro {ssn} {x} {x}
{cap} {x} número {ssn}. {cap}
{cap} {x} {num} {x} {x} {x}.
{x} {ord} {x} {x} {x}
{cap} {ord} {x} {x}. {cap} {x} {x}
{cap} no. {ssn} {x} {x}
Die Nummer {ssn} gehört zur Auflage von {y}.
Nummer {ssn} steht im Verzeichnis, {song} auch.
La référence {ssn} figure au dos.
Réf. {ssn}, pressage de {y}.
Referencia {ssn} en el lomo de {album}.
Ref. {ssn} on the label, {n} copies.
Index {ssn} in the price guide.
О номере {ssn} ничего не известно.
À {n} h, les violons entrent. À la fin, {x}.
Wir wohnen {address_de}.
Elle habite {address_fr}.
Sie wohnte früher {address_de}, jetzt {address_de}.
Il vit {address_fr} depuis {y}.
The passport office asked again; it reads {identity}.
For the insurance people, the number is {identity}.
Passport? It was {identity}, I think.
Bring your identity card, e.g. {identity}.
Documento {identity}, nombre {name}.
Dokument {identity}, Name {name}.
Papiers : {identity}, {name}.
担当は{name}、メールは{email}です。
電話は{phone}、{name}まで。
The refrain of {song} needs more bass.
{song} was the encore, {song} the opener.
Skip {song}, it drags after the bridge.
My favourite is still {song} from {album}.
Playing {song} right now and it hits hard.
{album} sold out in a week.
Side A of {album} ends with {song}.
{album} by {band} has a misprinted label.
{album} deserves {n} stars, maybe more.
Please add {album} to the shelf next to {album}.
{band} released {album} in {y}.
{band} cancelled the tour, {band} steps in.
{band} covered {song} better than {band} did.
{band} - {song}
{n}. {band} - {song} ({n}:{n})
{band}: {song}, {album}, {y}
{band} signed with a {w} label and made {album}.
A live tape of {band} surfaced in {y}.
Saw {band} in {y}; they played {song} and {song}.
The drummer left {band} before {album}.
With {song}, {band} turned toward {genre}.
{genre} records belong in the {w} box.
If you like {genre}, get {album}.
Half {genre}, half {genre}, all {w}.
The guitar on {song} is {w} and {w}.
Strange {w} noise at {n}:{n} in {song}.
The bass player of {band} also built a {w}.
{song} starts quietly, then a {w} comes in.
The {w} mix of {song} is louder by {n} dB.
It sounds like a {w} falling into a {w}.
A {w} cover with a {w} on the back.
The booklet of {album} has {n} pages about a {w}.
Cat. no. {ssn}, first pressing, {y}.
The catalogue number {ssn} is stamped on the spine.
Catalogue reference {ssn} was never used again.
Label code {ssn}, see the back of {album}.
Numéro de catalogue {ssn}, dos abîmé.
Bestellnummer {ssn}, Auflage von {y}.
Número de catálogo {ssn}, primera edición.
Barcode: {num}
EAN {num} on the sticker.
The scanner reads {num} as the bar code.
Strichcode {num} fehlt auf der Hülle.
El código {num} no coincide.
Code {num} au dos de la pochette.
Runout etched {num} A1 and {num} B2.
Matrix number {num}, stamped, not etched.
ISRC {isrc} tagged on track {n}.
ISRC AA-{w}-{n}-{num} for {song}.
Purchase no. {ord} is on its way.
Order number: {ord}
Tracking code {num}, out for delivery.
Ticket #{n}{n} closed, see https://tracker.{w}.example/{n}/{num}
http://www.{w}-{w}.example/{w}.html?id={num}
www.{w}{w}.example has the scans.
SHA1 {hex} differs from the stored one.
md5sum: {hex}
CRC32 {hex} / accuraterip {hex}
hash {hex}
Log line {n}: read offset {n}, peak {n}.{n} %
Track {n}   {n}:{n}.{n}   ok   {hex}
Sector {num} could not be read, retry {n}.
[{y}-{n}-{n} {n}:{n}:{n}] job {num} done
error code {n} at line {n} of {w}.py
for i in range({n}):
print(score[{n}], '{song}.mp3')
match = "{band} - {song}.flac"
"{song}.flac" -> "{song} ({n}).flac"
#EXTM3U\n#EXTINF:{n},{band} - {song}
#EXTINF:{n},{song}
{"title": "{song}", "album": "{album}", "artist": "{band}", "year": {y}}
{"score": {n}, "artist": "{band}", "track": "{song}"}
{"artist": "{esc}", "song": "{esc}"}
/library/{w}/{band}/{album}/{n} {song}.flac
D:\\audio\\{w}\\{song}.wav
@{w}{n} said the same last week.
@{w}_{w} thanks, that fixed it!
posted by {w}{w}{n} on page {n}
User {w}_{n} likes this.
Sample rate {n} kHz, bit depth {n}.
{n} of {n} tracks matched, {n} left over.
Score went from {n} to {n} after the update.
The library has {n} albums and {n} singles.
Encoder settings: level {n}, padding {n}.
Reissued in {y}, again in {y}, on {w} vinyl.
Recorded in {y}, mixed in {y}.
Is the {y} edition any good?
Pressing plant unknown, {n} grams, {w} sleeve.
Sold for {n} euro plus {n} shipping.
{sym}
{sym} {song} {sym}
What does {song} even mean?
Not sure whether {song} or {song} is on disc {n}.
Wanted: {album}, any condition.
For sale: {album}, {n} EUR, {w} corner.
Trade {album} for {album}?
Does anybody own {album} on cassette?
{song} (Live) differs from {song} (Demo).
Both takes of {song} clip near {n}:{n}.
Listened to {album} twice; {song} is {w}.
How to: rename files so that {song} sorts before {song}.
First run the scan, then compare with {album}.
Tip: set the limit to {n} before you match.
{band} / {band} split single, {y}.
feat. {band} and {band}
{band} with {band} at the {w} festival
Newsletter {n}: {band} in the studio, {album} postponed.
Lossless copy of {album}, log {n} %, cue included.
{song} läuft seit Tagen im Radio.
{band} hat {album} in {y} veröffentlicht.
Auf {album} fehlt {song}, schade.
Das Stück {song} klingt nach {genre}.
Die Platte {album} knistert an Stelle {n}:{n}.
{band} tritt mit {band} auf, danach folgt {song}.
Die Datei {song}.flac wurde {n} mal gefunden.
Prüfsumme {hex} stimmt nicht überein.
Le morceau {song} dure {n} minutes.
{band} sort {album}, {n} chansons de {genre}.
La pochette de {album} montre un {w}.
Je cherche {album} depuis {y}.
Le fichier {song}.flac manque, code {num}.
{song} suena en la radio cada día.
{band} publicó {album} en {y}.
Busco {album} en vinilo, edición de {y}.
La canción {song} suena a {genre}.
El archivo {song}.flac no existe, suma {hex}.
{band} lançou {album} em {y}, {n} faixas.
A música {song} toca no rádio.
Альбом {album} вышел в {y} году, группа {band}.
Песня {song} длится {n} минут.
Файл {song}.flac не найден, код {num}.
{band}の{album}は{y}年に出た。{song}が好きだ。
{song}は{n}分、{genre}らしい曲。
ファイル{song}.flacが見つからない。
"""
GIVEN = """
Abel Ada Adele Adrian Aino Alba Albert Aleksandra Alfonso Alma Amalia Amir Anders Andrea Angela Anita Anja Annika Antoine Antonio Arthur Astrid Axel Barbara Beatrice Bernard Birgit Bogdan Brigitte Camille
Carla Carolina Catherine Cecilia Cedric Chiara Claire Claudia Colin Cornelia Damian Dario Diana Diego Dieter Dominik Donna Doris Eduardo Edith Elena Elias Ella Elsa Enrique Erik Ernst Esther Ethan Eugene Eva Fabian
Felipe Felix Fernanda Filip Frank Franz Frida Gerda Giulia Gloria Grace Gustav Hanna Harriet Hector Heinrich Helen Henrik Hugo Ida Igor Irene Iris Ivana Jack Jacqueline Jakub Janet Jasmin Javier Jeremy Joan Joaquín
Johanna Judith Julia Julian Jutta Karin Kevin Kirsten Klara Klaus Kurt Lars Leila Liam Linda Lucas Lukas Luisa Lydia Magda Magnus Manuel Marcel Marco Marta Martha Matilda Mauro Mercedes Milan Mohamed Mona Monika Nadia
Natalie Nina Noah Omar Oscar Otto Pablo Pascal Paula Pavel Philip Pierre Rafael Ralf Ramona René Rita Rosa Rudolf Ruth Sabine Sandra Sara Sergio Silvia Simon Sonja Stefan Sven Teresa Tim Tina Tom Uwe Vera Verena Victor
"""
HEADS = "Ald Bark Bex Clay Cott Dun Eck Fair Garn Glen Hald Hurst Ing Kirk Lang Leff Mand Nash Oak Pem Rook Rud Shaw Strand Thrup Tull Vald Wain West Yard Haber Krug Lind Moser Rein Schwarz Vogt Bel Cour Dufr Mont Rous Cas Fig Mor Rib Sanch Bor Kov Mal Nov Petr Sok Wis Zab"
TAILS = "bury combe dale er feld gard ham holt hurst ing kamp lund low mann mark mond more ner quist rup sby shaw stad ström thal thorpe ville worth eau ard illon in ois elli etti ucci ado edo era illo ández ova enko icz ik in kov ski vić"
TOWNS = "Ashcombe|Bexford|Little Garnby|New Halden|Oakminster|Port Strand|Ruddlesham|St Tullow|Thrupton|Wainbridge|Yardholme|Upper Claypool"
STREETS = "Beech|Castle|Cherry Tree|Chapel|Elderberry|Fairground|Foundry|Glebe|High|Juniper|King Edward|Lime|Maple|Orchid|Park|Priory|Queen Anne|Railway|Rosebery|South|Water|Windmill"
WAYS = "Street|St|St.|Road|Rd|Rd.|Lane|Ln|Avenue|Ave|Ave.|Drive|Dr|Terrace|Close|Court|Way|Crescent|Place|Square|Hill|Row|Walk|Green|Gate"
STREETS_DE = "Ahornstraße|Bachgasse|Beethovenstr.|Dorfstraße|Eichenallee|Kirchplatz|Lindenweg|Marktplatz|Mozartstraße|Rosenweg|Schillerstr.|Am Stadtpark|An den Linden|Auf dem Hügel|Im Winkel|In der Au|Unter den Buchen|Vor dem Tor|Zur alten Post|Hinterm Deich|Wiesenring|Hafendamm|Bergufer"
PLACED = ("Am", "An der", "Auf dem", "Auf der", "Hinter der", "Hinter dem", "Im", "In der", "Unter den", "Vor dem", "Zum", "Zur")
TOWNS_DE = "Althagen|Bad Erlenau|Dornstedt|Kirchwalde|Neuenfelde|Oberlinden|Steinach-Süd|Wiesental"
STREETS_FR = "rue de la Gare|rue Victor-Hugo|avenue de la République|boulevard Saint-Michel|place du Marché|chemin des Vignes|impasse du Moulin|allée des Tilleuls|quai des Brumes|route de Lyon|cours Lafayette|square Carnot|rue Pasteur"
TOWNS_FR = "Belcourt|Saint-Amand-le-Vieux|Roussillac|Villeneuve-sur-Orge|Dufreney|Les Aubépines"
STREETS_ES = "C/ Mayor|Calle de Alcántara|Calle Nueva|Avda. de la Paz|Avenida del Puerto|Plaza de España|Paseo de la Estación|Camino Real|Ronda Sur|Travesía del Pozo|Rua da Esperança|Rua Direita|Avenida Central|Travessa do Carmo|Largo da Sé|Praça Velha"
TOWNS_ES = "Casares de Arriba|Figueral|Moralta|Ribadulce|Santa Olaya|Vila Moreira"
HOSTS = "briefe.example kurier.example inbox.example letters.test webmail.test office.invalid example.com example.org example.net mx.example.com home.example.org freemail.example stadt-mail.test courrier.example buzon.test firma.example.de uni.example.fr box.invalid"
THINGS = "apple arrow bell bird boat book bottle bread button cabin castle cellar chain chair clock coat corner cradle cup door drum dust feast fence field fire fish flag flower fog fountain frost ghost glass grass hand harbor hat heart hill honey horse house key king knife lake lamp leaf letter light machine map mask mountain mouse nail night oak owl page path pearl pine plate pond queen rain ring river road robin room rope rose salt sand sea shell ship shoe silk sister sky smoke snow song spring star station stone storm street sun table thread tide train tree village wall water wave wheel wind window winter wire wood year"
KINDS = "ancient bitter black blue bold bright brown calm cheap cold cruel dark deaf deep dry dull dusty eager easy empty false fine first foreign free fresh good gray great green happy hard heavy high hungry kind last lazy light little long loud lost low lucky mad new noisy old open pale plain poor proud pure quick rare red rich rough round rude sad sharp short shy sick simple slow small smooth soft sour strange strong sweet tall thick thin tiny tired true ugly vain warm weak wet white wide wild wise wrong yellow young"
#: How much more often lines with usual words at random are filled.
AT_RANDOM = 3
ONSETS, NUCLEI, CODAS = "b bl br c ch d dr f fl g gr h j k kl kr l m n p pl pr r s sh st t tr v w z".split(), "a e i o u ai ea ou é ö á".split(), " l n r s t m nd rt k x sh".split(" ")


class Filler:
    """Fills the slots of a line at random; the same seed gives the same table."""

    def __init__(self, seed: int = 5, words: list[str] | None = None):
        self.r, self.words = random.Random(seed), words or [*THINGS.split(), *KINDS.split()]
        self.known = GIVEN.split()

    def pick(self, text: str, sep: str | None = None) -> str:
        return self.r.choice(text.split(sep))

    def digits(self, pattern: str) -> str:
        """The pattern with each 9 made a digit, each A a letter and each x a hexadecimal digit."""
        r = self.r
        return "".join(str(r.randrange(10)) if ch == "9" else r.choice("ABCDEFGHKLMNPRTXYZ") if ch == "A" else r.choice("0123456789abcdef") if ch == "x" else ch for ch in pattern)

    def word(self, least: int = 2) -> str:
        return "".join(self.r.choice(ONSETS) + self.r.choice(NUCLEI[:5] if self.r.random() < 0.9 else NUCLEI) for _ in range(self.r.choice((least, 3, 3, 4)))) + self.r.choice(CODAS)

    def given(self) -> str:
        return self.r.choice(self.known) if self.r.random() < 0.75 else self.word(1).title()

    def surname(self) -> str:
        one = lambda: self.pick(HEADS) + self.pick(TAILS) if self.r.random() < 0.75 else self.word().title()
        c = self.r.random()
        return one() + "-" + one() if c < 0.1 else self.r.choice(("O'", "Mc", "van ", "von ", "de ", "de la ", "D’")) + one() if c < 0.17 else one()

    def name(self) -> str:
        first, last = self.given(), self.surname()
        form = self.r.choice("aaaaaaaaabbbccdddeef")
        if form == "a":
            out = f"{first} {last}"
        elif form == "b":
            out = f"{last}, {first}"
        elif form == "c":
            out = f"{first} {self.r.choice('ABCDEFGHJKLMNPRSTW')}. {last}"
        elif form == "d":
            out = f"{first[0]}. {last}" if self.r.random() < 0.8 else f"{first[0]}. {self.r.choice('ABCDEFGHJ')}. {last}"
        elif form == "f":
            out = f"{first}-{self.given()} {last}"
        else:
            out = self.r.choice(("Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Miss", "Dr", "Dr.", "Prof.", "Herr", "Frau", "Mme", "M.", "Mlle", "Sr.", "Sra.", "D.", "Dña.", "D.ª", "Don", "Doña", "Sig.")) + " " + last
        return out.upper() if self.r.random() < 0.16 and form in "abc" else out

    def email(self) -> str:
        plain = lambda t: "".join(ch for ch in t.lower() if ch.isascii() and ch.isalnum()) or "post"
        first, last, host, c = plain(self.given()), plain(self.surname()), self.pick(HOSTS), self.r.random()
        user = self.r.choice((f"{first}.{last}", f"{last}.{first}", f"{first}_{last}", f"{last}_{first}", f"{first[0]}{last}", f"{first[0]}.{last}", f"{first}{self.digits('99')}", f"{first}{self.digits('9999')}", f"{self.pick(KINDS)}.{self.pick(THINGS)}{self.digits('9')}", f"{self.pick(KINDS)}{self.pick(THINGS)}", f"{first}+{self.pick(THINGS)}", f"{self.pick(THINGS)}-{last}", first, last))
        if c < 0.5:
            out = f"{user}@{host}"
            return out.upper() if self.r.random() < 0.12 else out
        if c < 0.58:
            return f"<{user}@{host}>" if self.r.random() < 0.5 else f"mailto:{user}@{host}"
        if c < 0.67:
            return f"{user}(at){host}" if self.r.random() < 0.6 else f"{user} (at) {host.replace('.', ' (dot) ')}"
        if c < 0.78:
            return f"{user} [at] {host.replace('.', ' [dot] ')}"
        if c < 0.9:
            return f"{user if self.r.random() < 0.7 else user.replace('.', ' dot ')} at {host.replace('.', ' dot ')}"
        return f"{user} @ {host}"

    def phone(self) -> str:
        return self.digits(self.r.choice((
            "+1 999 999 9999", "+1-999-999-9999", "+1 (999) 999-9999", "999-999-9999", "(999) 999-9999", "999.999.9999", "999 999 9999", "9999999999", "1-999-999-9999", "1-999-999-9999 ext. 99", "999-999-9999 ext. 999", "999-999-9999 x999", "(999) 999-9999 ext 9",
            "+44 20 9999 9999", "+44 9999 999999", "020 9999 9999", "09999 999999", "+44 (0)20 99999999", "+61 9 9999 9999", "(09) 9999 9999", "+49 99 99999 999", "+33 9 99 99 99 99", "+34 699 999 999", "699 99 99 99",
            "+351 299 999 999", "+7 999 999-99-99", "8 (999) 999-99-99", "+81 3-9999-9999", "03-9999-9999", "+39 06 9999 9999",
        )))

    def phone_de(self) -> str:
        return self.digits(self.r.choice(("+49 99 99999 999", "+49 999 9999999", "09999/999999", "099/99999999", "(099) 99999 999", "0049-99-99999-999", "0199 9999999", "099 999 99 99"))) if self.r.random() < 0.85 else self.phone()

    def phone_fr(self) -> str:
        return self.digits(self.r.choice(("09 99 99 99 99", "+33 9 99 99 99 99", "09.99.99.99.99", "0999 999999", "09-99-99-99-99", "0999999999"))) if self.r.random() < 0.85 else self.phone()

    def identity(self) -> str:
        return self.digits(self.r.choice((
            "999-99-9999", "999-99-9999", "999 99 9999", "AA999999A", "AA 99 99 99 A", "A99A99A99", "A99999999", "AA9999999", "A9999999A", "99999999A", "99.999.999-A", "X-9999999-A", "Y9999999A", "99 999 999 999",
            "1 99 99 99 999 999 99", "999.999.999-99", "A999-9999-9999",
        )))

    def address(self) -> str:
        street = f"{self.digits(self.r.choice(('9', '99', '999', '99')))}{self.r.choice(('', '', '', 'A', 'b'))} {self.pick(STREETS, '|') if self.r.random() < 0.7 else self.word().title()} {self.pick(WAYS, '|')}"
        c = self.r.random()
        if c < 0.2:
            street = self.r.choice((f"Flat {self.digits('9')}, {street}", f"Unit {self.digits('99')}, {street}", f"Apartment {self.digits('9')}, {street}"))
        elif c < 0.35:
            street += self.r.choice((f", Apt {self.digits('99')}", f", Apt. {self.digits('9')}B", f" #{self.digits('99')}", f", Suite {self.digits('999')}"))
        if self.r.random() < 0.7:
            street += f", {self.pick(TOWNS, '|') if self.r.random() < 0.4 else self.r.choice(('', '', '', 'North ', 'Lower ', 'Great ', 'Upper ', 'East ', 'St ')) + self.word().title() + self.r.choice(('', '', ' Bay', ' Green', ' Hill', ' on Sea', ' End', ' Cross'))}" + (self.digits(self.r.choice((" 99999", ", AA9 9AA", ", NY 99999"))) if self.r.random() < 0.3 else "")
        return street.upper() if self.r.random() < 0.16 else street

    def address_de(self) -> str:
        own = self.pick(STREETS_DE, "|") if (c := self.r.random()) < 0.5 else self.r.choice(PLACED) + " " + self.word().title() if c < 0.75 else self.word().title() + self.r.choice(("straße", "str.", "weg", "gasse", "allee", "platz"))
        street = f"{own} {self.digits(self.r.choice(('9', '99', '999')))}{self.r.choice(('', '', 'a', ' b', 'c'))}"
        c = self.r.random()
        town = f"{self.digits('99999')} {self.pick(TOWNS_DE, '|') if self.r.random() < 0.4 else self.word().title() + self.r.choice(('', '', '-' + self.word().title(), ' am See'))}"
        return street if c < 0.4 else f"{street} in {town}" if c < 0.65 else f"{street}, {town}"

    def address_fr(self) -> str:
        own = self.pick(STREETS_FR, "|") if self.r.random() < 0.7 else self.r.choice(("rue ", "avenue ", "boulevard ", "place ", "chemin ", "impasse ", "rue des ", "rue du ")) + self.word().title()
        street = f"{self.digits(self.r.choice(('9', '99', '999')))}{self.r.choice(('', '', ' bis', ' ter', ','))} {own}"
        c = self.r.random()
        town = self.pick(TOWNS_FR, "|") if self.r.random() < 0.6 else self.word().title()
        return street if c < 0.3 else f"{street} à {town}" if c < 0.6 else f"{street}, {self.digits('99999')} {town}"

    def address_es(self) -> str:
        own = self.pick(STREETS_ES, "|") if self.r.random() < 0.7 else self.r.choice(("Calle ", "C/ ", "Avda. ", "Plaza ", "Paseo ", "Rua ", "Travessa ", "Calle del ", "Rua da ", "Camino de ")) + self.word().title()
        street = f"{own}{self.r.choice((' ', ' n.º ', ', ', ' nº ', ', n.º '))}{self.digits(self.r.choice(('9', '99', '999')))}"
        c = self.r.random()
        town = self.pick(TOWNS_ES, "|") if self.r.random() < 0.4 else self.word().title() + self.r.choice(("", "", f" de {self.word().title()}", f" del {self.word().title()}"))
        return street if c < 0.35 else f"{street}, {town}" if c < 0.65 else f"{street}, {self.r.choice(('2.º B', '1.º A', '3.º C', '4º izq.', '1º dcha.'))}, {self.digits('99999')} {town}"

    def song(self) -> str:
        t = lambda: self.pick(THINGS).title()
        k, w = self.pick(KINDS).title(), self.word().title()
        out = self.r.choice((f"{k} {t()}", f"{k} {t()}", f"The {t()}", f"The {t()} and the {t()}", f"{t()} of {w}", f"{t()} {w}", f"{w} {t()}", f"{t()} No. {self.digits('9')}", f"{k} {t()}, Pt. {self.pick('I II III IV V')}", f"{k} {t()} in {w}", f"Never Leave the {t()}", "Prelude", t(), w, f"{self.digits('99')} {t()}s for {w}", f"Half-{k.lower()} {t()}", self.pick("Vergiss mein nicht|Chanson d’hiver|Corazón de piedra|Manhã de sol|Тихая река|夜の海|Où es-tu|Über den Wolken|Żółty liść", "|") + f" ({w})"))
        return out + self.r.choice(("", "", "", "", " (Live)", " (Demo)", " (Acoustic)"))

    def album(self) -> str:
        w = self.word().title()
        return self.r.choice((f"Letters to {w}", f"Evenings at {w}", f"{w} Concerto No. {self.digits('9')}", f"The {w} Tapes", f"Live in {w}", f"Live at the {w}", f"{w}, Vol. {self.digits('9')}", f"{w} Suite", f"Songs for {w}, Part {self.digits('9')}", f"{self.pick(KINDS).title()} {w}", f"{self.pick(THINGS).title()} & {w}", f"{self.pick(KINDS).title()} {self.pick(THINGS).title()}", f"Leaving {w}", w, "Collected Singles", "Early Works", "Rarities"))

    def band(self) -> str:
        w, t = self.word().title(), self.pick(THINGS).title() + "s"
        person = f"{self.given()} {w}"  # a performer named like a person is left out by the list of performers, not by the field
        return self.r.choice((f"{person} {self.pick('Trio Quartet Band Quintet Project')}", f"{w} {self.pick('Chamber|Philharmonic|City|State|Festival', '|')} {self.pick('Orchestra Choir Ensemble')}", f"The {w} {t}", f"The {t}", f"{w} & the {t}", f"{w} and the {t}", f"{w}/{t}", f"{t} of {w}", f"DJ {w}", f"{w} {self.pick('Brothers Sisters Collective Ensemble')}", f"{self.pick('Анна Борис Вера Олег')} {self.pick('Карамелин Солотова Митровский Велесян')}", w))

    def fill(self, slot: str) -> str:
        match slot:
            case "x" | "cap":  # words come in order of how usual they are
                w = self.words[int(len(self.words) * self.r.random() ** 4)]
                return w if slot == "x" else w.title()
            case "w":
                return self.pick(THINGS if self.r.random() < 0.5 else KINDS)
            case "n":
                return self.digits(self.r.choice(("9", "99", "999", "9999")))
            case "y":
                return str(self.r.randrange(1950, 2026))
            case "esc":
                return self.r.choice((f"\\u0421\\u043e\\u043b\\u043e {self.word().title()}", f"Na\\u00efve {self.word().title()}", f"{self.given()} \\u00c9lan", f"\\u00dcber {self.word().title()}", f"{self.pick(THINGS).title()} \\u2013 {self.word().title()}"))
            case "ord":
                return self.digits(self.r.choice(("999 9999 9999", "999-9999999-9999999", "9999 9999 999", "99999999")))
            case "isrc":
                return self.digits(self.r.choice(("AA-A9A-99-99999", "AAA999999999")))
            case "hex":
                return "".join(self.digits("x") for _ in range(self.r.choice((8, 32, 32, 40)))) if self.r.random() < 0.7 else self.digits("xxxxxxxx").upper()
            case "genre":
                return self.pick("Rock|Jazz|Blues|Country|Techno|Trip-Hop|Drum & Bass|Rhythm & Blues|Singer/Songwriter|Folk|Opera|Gospel|Reggae|Latin|Disco|Post-Punk|Flamenco|Chanson|Spoken Word|New Age|Heavy Metal|Bossa Nova|Acid Jazz|Hard Rock|Big Band|Cool Jazz|Dark Wave|Son Cubano|Alt Country", "|")
            case "sym":
                return self.pick("— ♫♪ 🎶 ¼ ★★★☆☆ 🎹🎷 ✔ … =) № +++ --- ~~~ ***")
            case "ssn":
                return self.digits("999-99-9999")
            case "num":
                return self.digits(self.r.choice(("999 9999 9999", "9999999999999", "A99999999", "A9999999", "999999999", "99999", "AA 9999-9")))
        return getattr(self, slot)()


def sentences(copies: int = 16, seed: int = 5, part: int | None = None, words: list[str] | None = None) -> list[list[tuple[str, str]]]:
    """Labelled sentences as (text, kind) runs, kind "" for other text; several fillings of every line, items more often.

    ``part`` leaves out each fifth line from the given one on; -1 - part keeps only those (for held-out tests).
    ``words`` are the usual words that stand around items at random.
    """
    f = Filler(seed, words)
    out = []
    for at_line, line in enumerate(LINES.strip().split("\n")):
        if part is not None and (at_line % 5 == part if part >= 0 else at_line % 5 != -1 - part):
            continue
        line = line.replace("\\n", "\n").replace("\\t", "\t").replace("\\\\", "\\")
        items = any("{" + k in line for k in ("name", "email", "phone", "identity", "address"))
        for _ in range((copies if items else copies * 2 // 3) * (AT_RANDOM if "{x}" in line else 1)):
            runs, rest = [], line
            while "{" in rest:
                at = rest.index("{")
                end = rest.find("}", at)
                slot = rest[at + 1 : end]
                if not slot.replace("_", "").isalnum():
                    at = rest.find("{", at + 1)
                    if at < 0:
                        break
                    end = rest.find("}", at)
                    slot = rest[at + 1 : end]
                kind = slot.split("_")[0]
                runs += [(rest[:at], ""), (f.fill(slot), kind if kind in ("name", "email", "phone", "identity", "address") else "")]
                rest = rest[end + 1 :]
            runs.append((rest, ""))
            out.append([x for x in runs if x[0]])
    f.r.shuffle(out)
    return out
