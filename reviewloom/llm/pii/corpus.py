"""Labelled training text for the tagger: sentences with known spans.

Every text is assembled from carriers with slots; a slot is filled by a
generator of its type, so spans are known exactly. Neutral sentences and
look-alikes (order, batch, serial, parcel and model numbers, handles, prices,
product names) carry no label.
"""

from __future__ import annotations

import random

TYPES = ("email", "phone", "id_number", "address", "name")

_GIVEN = "Anna Ben Carla David Emma Felix Greta Hugo Ines Jan Karla Leon Maria Nils Olga Paul Rosa Sven Tina Uwe Vera Wim Yara Zoe Mary John Peter Sarah Michael Laura James Claire Pierre Sophie Luc Chloé Jürgen Jörg Zoë Anaïs".split()
_FAMILY = "Smith Jones Brown Taylor Miller Wilson Moore Clark Young King Wright Hill Baker Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Koch Richter Klein Wolf Dupont Martin Bernard Petit Durand Leroy Moreau Laurent de_Vries Jansen Bakker Visser Bright Frost Marsh Stone Winter Reed Sharp Wells Hollow Plain".split()
_G1 = "Bre Cal Fen Hed Ila Jo Mu Ny Ori Quo Ru Sa Ta Vel Ze Ka Lo Mi Tor Al".split()
_G2 = "mar la lo vi sse dri ne ss ru mo".split()
_G3 = "dor rila ra ric th ne ska wen lin mo vine la na r n s".split()
_F1 = "Brad Dra Frode Fro Golde Gol Harbe Har Kes Lun Mor Nim Osk Pell Quen Sten Til Wex Yar Lind Bran Ros".split()
_F2 = "be de ka ling ri sto vo ".split(" ")
_F3 = "zen sky ley wick holt quist mann row ford stead l rizen bel vol kal son berg".split()
_ROAD = "Cinder Kiln Quill Osier Heron Thistle Candle Copper Fallow Juniper Larkmere Milestone Mossgate Orchid Plover Ropewalk Saltpan Tannery Wicker Bellfounder Church Station Park Mill Garden Linden Rosen Haupt Bahnhof High Victoria Oak Maple Nelson".split()
_KIND = ("Street", "street", "St.", "Road", "Rd", "Lane", "Ln", "Avenue", "Ave", "Close", "Terrace", "Blvd", "Drive", "Court", "Way", "road", "lane", "Place", "Square")
_HOST = "wyn dun mel cran vingle harse oste torte gar linte pol kel sed ash bram".split()
_HOST2 = "vale court ham by worth bach mouth field wick stow haven ton berg".split()
_HOST3 = ("", "", "mail", "post", "works", "-net")
_TLD = ("test", "example", "invalid", "co.example", "com", "org", "net", "de", "fr", "co.uk", "io")

NEUTRAL = """Solid four stars. Bought as a gift. Nothing more to add. Not sure yet. Works with the old stand. Très correct dans l'ensemble. Colour is darker than shown. Came with a spare cable. I’d say “fine”, no more. Ich bin soweit zufrieden. My sister has the same one. Third one in this house. Would buy again. So far so good… Seen it for less elsewhere. Packaging was excellent. The box was sturdy and neat. Packaging was torn and dirty. The menus are clear. Cheap and good. Delivery was fast. The price is fair. The battery lasts two full days. Battery life is excellent. The box arrived crushed. Build quality is excellent. Great lens for the size. It starts quickly. The camera is sharp even at dusk. My father could use it at once. Charging is quick and reliable. The sound is lovely. Performance is smooth with many apps open. Everything runs fast. Photos look clear and bright. Shipping went smoothly. Worth every penny. The finish feels solid. Pairing it was child's play. The courier was early and polite. The parcel came a week late. The hinge broke in a week. The battery is empty by lunchtime. Setup was confusing. The camera is blurry indoors. Overpriced compared with the old one. Battery swells and is weak. The courier left it in the rain. The price is awful. Photos come out grainy. The manual is useless. The buttons are hard to reach. Charging became slow after a month. The plastic feels cheap and fragile. Shipping was slow and confusing. It lags and freezes. Menus are slow. Performance is bad after the update. Build quality is poor. Far too expensive for what it is. The lens is poor in low light. The call centre was useless and e-mail support never replied. The shop on the high street had none. Fine. Used it daily since April. The street address field in the form is too short. My phone rang all day. The neighbours like it too. They asked for my name, which I refused. Ask your doctor first. Die Lieferung kam pünktlich. Leider defekt angekommen. Livraison rapide. Le prix est correct. De kleur is mooi. Customer service answered within an hour. Second day: same. Update: fixed, mostly. PS, the cable is short. The road test was fun. Mr Universe would like it. Thanks for the help! Gruß aus dem Norden. I live in the north. Signed for by a neighbour. Call me impressed.""".replace("\n", " ")
LOOKALIKE = [
    "Serial #### #### #### on the label.", "Order ####-####-## took ## days.", "Batch no. 2026####-####, if that helps.", "Tracking ZX########GB went silent.", "Model TX-###-#### fits as well.", "Firmware #.#.##.### fixed it.",
    "Ratio 16:9, #### x #### pixels.", "Rated 5/5, 100% happy, #### uses so far.", "Part ###-###-#### is missing from the kit.", "Paid #,###.## on ##/##/2026.", "Version 2026.##.## is better.", "Weighs about ## grams.", "Returned it after ## days.",
    "Plugged it in at ##:## and it was full by ##:##.", "Shout-out to @gadget_### for the tip.", "Meet me @ noon was the courier's note.", "Article ########## was swapped.", "Parcel ZZ########## never came.", "Invoice ###-##-#### is wrong.", "SKU ####### ###.",
    "Lot ######### expired.", "IMEI ############### is printed inside.", "Ticket #####-## closed.", "Parcel no. ### ## #### arrived.", "Ask for part ##-###-##.", "Size ## x ## x ## cm.", "Barcode ############# scans.", "Follow @%g on the forum.", "Model %R ### is the older one.",
    "The %G lamp in blue is nicer.", "The %F Stand is sturdy.", "Grand %R edition, limited to #### pieces.", "The %R case fits.", "The %F speaker beats the %G one.", "A %R bag came with it.", "The new %F model is heavier.", "%G Pro is louder.", "Serial ###-##-#### on the box.", "Order %U%U ## ## ## % shipped.",
]
CARRIERS = {
    "email": ["Write to me at {}.", "Reach me <{}> please.", "mailto:{}", "E-Mail an {} blieb ohne Antwort.", "my mail is {} if you need pictures", "sent three photos from {} and heard nothing", "invoice went to {} by mistake,", "({}) is where the invoice should go.", "{} – same address as on the account.", "Contact: {}", "Email {} for details.", "My address {} was leaked.", "mail: {}", "Écrivez à {} svp.", "they replied from {}, finally", "Questions? {}!"],
    "phone": ["my number: {}, ask for a refund", "Fax {} (yes, fax)", "whatsapp {} pls", "sms to {} is fine", "Rückruf bitte unter {}.", "Tel. {}", "Call me on {} after six.", "You can ring {} any time.", "the driver kept ringing {} instead of the bell", "{} is my work line.", "Nobody called {} back.", "Phone: {}", "Telefon {}", "Appelez le {} svp.", "reach me under {}!", "mobile {}", "{}"],
    "id_number": ["They even wanted my national ID, {}.", "Social security {} for the credit check, really?", "numéro de sécurité sociale {} demandé deux fois", "the form showed my SSN ({}) to everyone", "I had to type my tax number {} twice.", "citizen card {} rejected", "Insurance no. {} was on the parcel!", "passport no. {} should not be printed on a label.", "ID: {}", "Personalausweis {} wurde verlangt.", "Insurance no. {} should not be printed on a label.", "passport no. {} was on the parcel!", "My passport {} was scanned.", "Steuernummer {} stand drauf.", "they kept my social security number {}.", "National insurance {} on file.", "Reisepass {} kopiert.", "my tax ID {} leaked", "SSN {} visible"],
    "address": ["Please deliver to {} next time.", "I live at {}, the courier went elsewhere.", "pick-up point was {} (closed)", "Adresse: {}.", "Sent to {}, not to my office!", "neighbours at {} took it in", "livré au {} par erreur", "We moved to {} in March.", "Collection from {} never happened.", "Left outside {} in the rain.", "Address: {}", "it went to {} again.", "Lieferung an {} bitte.", "Bring it to {}!", "my flat, {}, has no bell.", "deliver to {}"],
    "name": ["Thanks to {} for the help!", "Gruß, {}", "- {}", "Signed, {}", "Mr {} at the desk was kind.", "Frau {} war sehr nett.", "Herr {} hat geholfen.", "Mme {} m'a répondu.", "a certain {} signed for my parcel", "I spoke with {} twice.", "Ask Dr. {} about the noise.", "My name is {} and I want a reply.", "Reviewer: {}", "bought for my niece {} last week", "{} from the repair desk promised a call.", "Regards, {}", "Mrs. {} answered.", "the agent {} was rude.", "Prof. {} recommended it.", "Merci à {} !", "My friend {} agrees.", "Best, {}", "{} helped me.", "Miss {} packed it.", "The technician, {}, fixed it.", "our neighbour, {}, agrees."],
}


class Maker:
    """Random texts with spans. ``given`` and ``family`` are optional known names."""

    def __init__(self, seed: int, given: list[str] | None = None, family: list[str] | None = None):
        self.r = random.Random(seed)
        self.known_given, self.known_family = given or [], family or []
        self.neutral = [s + end for s, end in self._split(NEUTRAL)]

    @staticmethod
    def _split(text: str) -> list[tuple[str, str]]:
        out, cur = [], ""
        for word in text.split(" "):
            cur = f"{cur} {word}" if cur else word
            if word[-1:] in ".!?…" and word not in ("Mr",):
                out.append((cur, ""))
                cur = ""
        return out

    def given(self) -> str:
        r = self.r
        if self.known_given and r.random() < 0.35:
            return r.choice(self.known_given)
        return r.choice(_GIVEN) if r.random() < 0.2 else r.choice(_G1) + (r.choice(_G2) if r.random() < 0.5 else "") + r.choice(_G3)

    def family(self) -> str:
        r = self.r
        if self.known_family and r.random() < 0.35:
            return r.choice(self.known_family)
        return r.choice(_FAMILY).replace("_", " ") if r.random() < 0.25 else r.choice(_F1) + r.choice(_F2) + r.choice(_F3)

    def name(self) -> str:
        r = self.r
        first = f"{self.given()[0]}." if r.random() < 0.2 else self.given()
        if r.random() < 0.12:
            first += f" {r.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ')}."
        last = self.family()
        if r.random() < 0.12:
            last += "-" + self.family()
        n = f"{first} {last}"
        p = r.random()
        return n.upper() if p < 0.08 else n.lower() if p < 0.2 else n

    def digits(self, pattern: str) -> str:
        r = self.r
        out = []
        for ch in pattern:
            out.append(r.choice("0123456789") if ch == "#" else r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if ch == "^" else ch)
        return "".join(out)

    def email(self) -> str:
        r = self.r
        g, f = self.given().lower(), self.family().lower().replace(" ", "")
        user = r.choice([f"{g}.{f}", f"{g}-{f}", f"{g}_{f}", f"{g[0]}{f}", f"{f}_{r.randint(1, 999)}", f"{g}+shop{r.randint(1, 9)}", f"{g[0]}{f}{r.randint(1, 99)}", g, f"{f}{r.randint(1, 99)}"])
        user = user.encode("ascii", "ignore").decode() or "user"
        host = r.choice(_HOST) + r.choice(["", "", "o", "ing", "er"]) + r.choice(_HOST2) + r.choice(_HOST3)
        tld = r.choice(_TLD)
        p = r.random()
        if p < 0.62:
            e = f"{user}@{host}.{tld}"
        elif p < 0.72:
            e = f"{user} @ {host}.{tld}"
        else:
            at = r.choice([" AT ", " [at] ", " (at) ", "(at)", "[at]", " at "])
            dot = {" AT ": " DOT ", " [at] ": " [dot] ", " (at) ": " (dot) "}.get(at, ".") if r.random() < 0.8 else "."
            e = f"{user}{at}{host}{dot}{tld.replace('.', dot)}"
        return e.upper() if r.random() < 0.12 else e

    def phone(self) -> str:
        r = self.r
        return self.digits(r.choice(["+44 7700 900 ###", "07700 900###", "07700900###", "0044-7700-900###", "+49 30 23125 ###", "030/23125-###", "+33 1 99 00 ## ##", "01.99.00.##.##", "020 7946 0###", "###-555-01##", "(###) 555 01##", "+1 (###) 555-01##", "+## ### #######", "0### #######", "0##/#######", "###.###.####", "(0##) ### ####", "+##########", "0# ## ## ## ##", "0## ####-####", "+## (0) ## #### ####", "1-800-###-####"]))

    def id_number(self) -> str:
        r = self.r
        return self.digits(r.choice(["###-##-####", "###-##-####", "### ## ####", "^^ ## ## ## ^", "^^######^", "ZZ##########", "X########", "#### #### ####", "^########", "^^#######", "# ## ## ## ### ### ##", "##/###/#####", "###########", "^^########", "## ### ### ###"]))

    def address(self) -> str:
        r = self.r
        n, road = f"{r.randint(1, 299)}{r.choice('abc') if r.random() < 0.15 else ''}", r.choice(_ROAD) if r.random() < 0.7 else self.family().split(" ")[-1]
        p = r.random()
        if p < 0.5:
            a = f"{n} {'N. ' if r.random() < 0.12 else ''}{road} {r.choice(_KIND)}"
            return a.lower() if r.random() < 0.25 else a
        if p < 0.66:
            return f"{n} rue {r.choice(['', '', 'de la ', 'du '])}{road}" if r.random() < 0.6 else f"{n}, {r.choice(['place du', 'avenue du', 'place de la', 'rue du', 'rue'])} {road}"
        if p < 0.95:
            return f"{road}{r.choice(['weg', 'straße', 'weg', 'strasse', 'gasse', 'platz', 'allee', 'straat', 'laan'])} {n}"
        return f"{road} {r.choice(['Weg', 'Straße', 'Allee'])} {n}"

    def plain(self) -> str:
        r = self.r
        p = r.random()
        if p < 0.6:
            s = r.choice(self.neutral)
            if r.random() < 0.04:
                s += " " + r.choice(["😀", "👍👍", "★★★★", "❤️", "€ 20", "½ price", "日本", "№ 5", "\u00a0", "→ ok"])
            if s[-1:] == "." and r.random() < 0.3:
                s = s[:-1] + r.choice(";!;!")
            if r.random() < 0.12:
                t = r.choice(self.neutral)
                s = f"{s[:-1]}, {r.choice(['but', 'and', 'however'])} {t[0].lower()}{t[1:]}"
            return s
        s = self.digits(r.choice(LOOKALIKE).replace("^", ""))
        for slot, fill in (("%G", self.given), ("%F", self.family), ("%R", lambda: r.choice(_ROAD)), ("%g", lambda: self.given().lower()), ("%U", lambda: r.choice("ABCDEFGH"))):
            while slot in s:
                s = s.replace(slot, fill(), 1)
        return s

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A text and its spans (start, end, type)."""
        r = self.r
        kinds = ["plain"] * r.randint(0, 4) + [r.choice(TYPES) for _ in range(r.choice([0, 1, 1, 1, 2, 2, 3]))]
        r.shuffle(kinds)
        out, spans = "", []
        for k in kinds or ["plain"]:
            if out:
                out += " " if r.random() < 0.97 else r.choice(["\n", "  "])
            if k == "plain":
                out += self.plain()
                continue
            carrier = r.choice(CARRIERS[k])
            value = getattr(self, k)()
            before, after = carrier.split("{}")
            out += before
            spans.append((len(out), len(out) + len(value), k))
            out += value + after
            if k == "name" and r.random() < 0.06 and not after:  # two names with nothing but a blank between
                other = self.name()
                out += " "
                spans.append((len(out), len(out) + len(other), k))
                out += other + " from the repair desk promised a call."
        return out, spans
