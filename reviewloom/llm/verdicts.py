"""Verdicts on message templates, and the prefix tree in which they are mined.

A verdict follows from what a message speaks of, not from its wording: things
of the web (a page, a request), terms of software (a browser, a server),
failures (not found, denied, timed out), remedies (enable, allow, try again),
codes, filler, navigation; reported speech and the past tense speak against it.
Words are compared as scans may have read them: letters that scans take for one
another are one, and the lexicon is folded in the same way.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator
from operator import eq

import ahocorasick

from reviewloom.llm.folding import CONFUSED, PAIRS

DEPTH = 2  # tokens that name a leaf, after the number of tokens
SIMILAR = 0.6  # share of equal tokens from which two messages have one template
THRESHOLD = 3.0
NEAR = 6  # a message speaks of its matter within its first tokens after this one

# Lexicon: a trailing * leaves the end of the word open. Languages: English, German, French, Spanish, Italian, Dutch, Portuguese.
LEXICON: dict[str, str] = {
    "script": """javascript*, java script*, script, scripts, scripting, active content, cookie, cookies, active x, skripte*, skript*, guiones""",
    "enable": """enable*, enabling, activate*, allow, allowed, allows, permit, permits, turn on, turn it on, turn them on, turned on, turn off, switch on, switched on, switch*, must be on, needs, need, requires, require, aktivieren*, aktiviert, einschalten, activez, activer, autoris*, habilit*, activ*, permita, permitir, attiva*, abilita*, schakel, inschakelen, ative, ativar, disabled, load""",
    "plain": """too many requests, too many connections, internal server error, page not found, file not found, you have been blocked, something went wrong, iets misgegaan, traceback most recent, session has ended, session expired, your session, attention required, looking for, can t be reached""",
    "tech": """browser*, url, urls, http, https, www, server*, gateway*, proxy, timeout, time-out, timed out, status code, status #, stack trace, traceback, nullpointer*, nullimage*, null pointer, undefined, captcha, recaptcha, cloudflare, dns,
        ssl, login, log in, sign in, signed in, log on, session, sessions, cache, reload, refresh, webseite*, website*, web site, web page, webpage*, navigateur, serveur, navegador, servidor, sitzung*, sesión, sessione, sessie, sessão, ad blocker, adblock*, plugin, plug-in,
        flash player, json, html, xml, php, sql, database, datenbank, base de datos, base de données, iframe, webgl, webmaster, administrator, administrador, offline, robot, human, bot, bots, ray id, internal error, error code, parse error, syntax error, runtime error, unhandled, debug, module, ip address, uncaught, fatal error, database error, error interno, erreur interne, interner fehler""",
    "thing": """page, pages, file, document, dokument, image, images, scan, link, request*, resource*, content, article, address, account, service*, access, connection, viewer, reader, tile, tiles, archive, node, issue, view, preview, player, video, map, widget, component, app, domain, host, connexion, application, seite*, datei*, bild, verbindung, zugriff,
        dienst, anfrage, adresse, inhalt*, artikel, fichier, lien, demande*, accès, ressource, numéro, página, archivo, solicitud, recurso, enlace, acceso, contenido, cuenta, pagina, risorsa, richiesta, accesso, verzoek, toegang, pedido, acesso, arquivo, sito, cette page, something, iets, algo, qualcosa, there""",
    "fail": """not found, not be found, not be *, could not, couldn t, cannot, can t, can not, unable to, failed, failure, does not exist, doesn t exist, no longer, not available, unavailable, denied, forbidden, expired, refused, rejected, blocked, unauthorized, unauthorised, out of reach, oops, whoops, uh oh, sorry, error occurred, error has occurred, an error,
        invalid, not permitted, not authorized, not allowed, not private, not secure, temporarily, maintenance, went wrong, does not support, doesn t support, not supported, bad gateway, bad request, disabled, disconnected, interrupted, overloaded, out of memory, has moved, have moved, not responding, not valid, missing, took too long,
        nicht gefunden, nicht verfügbar, nicht erreichbar, nicht geladen, nicht geöffnet, nicht angezeigt, nicht erlaubt, verweigert, abgelaufen, fehlgeschlagen, existiert nicht, wartung*, gesperrt, ungültig*, leider, vorübergehend, momentan*, introuvable, indisponible*, refusé*, expiré*, échec, échoué*, n existe pas, n existe plus, interdit, désolé*, impossible,
        no encontrad*, no se encuentra, no se pudo, no disponible, denegad*, no existe, caducad*, prohibid*, lo sentimos, non trovat*, non disponibil*, non esiste, negato, scadut*, niet gevonden, niet beschikbaar, bestaat niet, geweigerd, verlopen, não encontrad*, nao encontrad*, não existe, nao existe, indisponív*, negado, expirad*""",
    "fix": """requires, require, required, upgrade, update your, please, kindly, contact the, contact us, return to, go back, check the, check your, checking your, verify, to continue, to proceed, to view, before you,
        in order to, slow down, wait, retry, try again, try later, you must, you requested, you are looking for, requested, looking for, was requested, start page, home page, homepage, startseite, bitte, melden sie, erforderlich, veuillez, réessay*, requis, accueil, por favor, inténtelo, inicie, iniciar, riprova*, si prega,
        probeer, tente novamente, request id, reference #, ref #, incident, support id, supporting""",
    "past": """said, says, saying, he, she, his, her, hers, him, himself, herself, they, them, their, were, was, had, mr, mrs, miss, dr, rev, persons, people, yesterday, last week, monday, tuesday, wednesday, thursday, friday, saturday, sunday, told, replied, announced, reported, stated, declared, asked, wrote, sagte, wurde, wurden, war, waren, herr, frau, er, sie sagte, hatte, dit, disait, était, étaient, fut, avait, monsieur,
        madame, elle, dijo, fue, era, eran, señor, había, disse, era stato, signor, zei, werd, was de, mijnheer, senhor, foi, parish, curate, clerk, mayor, children, telephone*""",
    "filler": """dummy, placeholder*, sample, samples, lorem*, ipsum*, lipsum, layout, mock up, mockup, mock-up, wording, headline*, body copy, copy goes, goes here, comes here, go here, appear here, appears here, to come, coming soon, under construction, your text, insert text, insert your, type here, write here, text here, add text, filler, hier steht, hier kommt, text folgt, folgt in kürze, in kürze, en construction, pour la maquette,
        maquette, à venir, faux texte, texte factice, exemple de texte, texto de ejemplo, texto de relleno, relleno, marcador de posición, texto aquí, testo segnaposto, testo di esempio, segnaposto, voorbeeldtekst, texto de exemplo, blindtext*, mustertext*, platzhalter*, beispieltext*, fülltext*, opvultekst, quick brown fox, lazy dog, tbd, tbc, foo, bar, baz, foobar, asdf*, qwert*, test test, test post, test page, hello world, lipsum""",
}
STRONG = "lorem ipsum, lorem*, blindtext*, faux texte, texte factice, dummy text, placeholder text, placeholder, sample text, text goes here, copy goes here, your text here, texto de relleno, texto de ejemplo, testo segnaposto, voorbeeldtekst, mustertext*, beispieltext*, fülltext*, quick brown fox, hello world, coming soon, under construction"
NAV = "help, home, back, cookies, imprint, impressum, contact, kontakt, login, log in, sign in, sign up, register, menu, search, suche, privacy, datenschutz, terms, agb, about, about us, faq, next, previous, top, start, sitemap, accueil, aide, mentions légales, inicio, ayuda, contacto, impresión, share, print, subscribe, newsletter, settings, profile, logout, more, news, blog, hilfe, zurück, weiter"
#: Whole messages of navigation.
NAV_FORMS = re.compile(
    r"skip to (?:\w+ )?(?:content|text|navigation|menu)|(?:loading|please wait|lädt|laden|chargement|cargando|caricamento|carregando)(?: \w+)?|(?:page |seite |página )?# (?:of|von|de|sur|di|van) # (?:pages?|seiten?|results?|páginas?|pagine)"
    r"|(?:request|ray|incident|support|error|reference|trace) id:? ?[#\w]*|(?:return|go back|back|zurück|retour|volver|tornare?|terug|voltar) (?:to|zur|zum|à|al|alla|naar|para) (?:the |la |el |a )?(?:[\w-]+ ){0,2}(?:page|übersicht|startseite|home|homepage|accueil|inicio|site|pagina|página|start)"
    r"|contact (?:the )?(?:\w+ ){1,3}(?:if|when) (?:this|the|you|it).*|(?:please )?(?:sign|log) in(?: again)?(?: to .*)?|(?:page )?last (?:updated|modified).*|click here(?: to .*)?|read more",
    re.I,
)
_COUNTING = frozenset("one two three four five six seven eight nine ten eins zwei drei vier fünf sechs sieben acht neun zehn un deux trois quatre cinq six sept huit neuf dix uno dos tres cuatro cinco seis siete ocho".split())
_WEIGHT = {"plain": (3.0, 0.5), "script": (1.0, 0.5), "enable": (1.0, 0.5), "tech": (2.0, 1.0), "thing": (1.0, 0.5), "fail": (1.5, 1.5), "fix": (1.0, 0.5), "filler": (1.5, 1.5), "past": (-1.5, -1.5)}

_SAME = str.maketrans({c: s for s, cs in CONFUSED.items() for c in cs if c not in "!|"})
_NOT_WORD = re.compile(r"[^\w#]+|_+")


def _base(ch: str) -> str:
    """The small letter or digit of a character without its accent; a blank for any other sign but '#'."""
    for c in unicodedata.normalize("NFKD", ch).lower():
        if c.isalnum() and c.isascii():
            return c
    return "#" if ch == "#" else " "


#: The same for a whole text in the code page of western languages, in one step each.
_SMALL = bytes(ord(_base(bytes([i]).decode("cp1252", "replace"))) for i in range(256))
_FOLDED = bytes(ord(chr(i).translate(_SAME)) if i < 128 else i for i in range(256))
_WIDE = str.maketrans({"ſ": "s", "ß": "ss", "ﬁ": "fi", "ﬂ": "fl", "−": "-"})


def small_letters(text: str) -> str:
    """Small letters without accents, and digits; blanks for all other signs. One character may become two."""
    try:
        return text.replace("ß", "ss").encode("cp1252").translate(_SMALL).decode("latin-1")
    except UnicodeEncodeError:
        text = "".join(c for c in unicodedata.normalize("NFKD", text.translate(_WIDE)).lower() if not unicodedata.combining(c))
        return _NOT_WORD.sub(" ", text)


def folded(text: str) -> str:
    """``small_letters`` as any misread copy may have them."""
    low = small_letters(text)
    for a, b in PAIRS:
        low = low.replace(a, b)
    return low.translate(_SAME) if not low.isascii() else low.encode().translate(_FOLDED).decode()


def fold_word(word: str) -> str:
    return folded(word).strip()


def tokens_of(message: str) -> list[str]:
    """The folded words of a message; a number is '#'."""
    return folded(message.replace("#", " # ")).split()


def _plain(text: str) -> str:
    """Words in small letters without accents, between blanks."""
    return " ".join(small_letters(text.replace("#", " # ")).split())


CERTAIN = 5  # letters from which a phrase may be misread; shorter ones would be taken for one another


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    found: dict[str, list[tuple[str, int, str | None]]] = {}
    for concept, words in [*LEXICON.items(), ("strong", STRONG)]:
        for phrase in words.split(","):
            phrase = phrase.strip()
            is_open = phrase.endswith("*")
            key = " " + " ".join(tokens_of(phrase.rstrip("*"))) + ("" if is_open else " ")
            plain = None if sum(map(str.isalnum, key)) >= CERTAIN and "#" not in key else _plain(phrase.rstrip("*"))
            found.setdefault(key, []).append((concept, len(key.split()), plain))
    for key, what in found.items():
        a.add_word(key, (key, what))
    a.make_automaton()
    return a


@functools.cache
def _nav_words() -> frozenset[str]:
    return frozenset(" ".join(tokens_of(w)) for w in NAV.split(","))


_MAY_PART = re.compile("[|·•›»>/]")
_PARTS = re.compile(r"\s*[|·•›»>/]\s*")


_RUN = re.compile("|".join("abcdefghijklmnopqrstuvwxyz"[i : i + 4] for i in range(23)))


def letters_in_order(message: str) -> bool:
    """Whether the letters run through the alphabet, or words are only numbers counted up."""
    low = message.lower()
    letters = [c for c in low.encode("ascii", "ignore") if 97 <= c <= 122] if _RUN.search(low) else ()
    if len(letters) >= 8:
        step = [b - a for a, b in zip(letters, letters[1:])]
        if step.count(1) >= 0.7 * len(step):
            return True
    words = low.split()
    if not words or words[0] not in _COUNTING:
        return False
    return len(words) >= 4 and sum(w in _COUNTING for w in words) >= 0.8 * len(words)


def classify(message: str, tokens: list[str] | None = None) -> str:
    """``script``, ``error``, ``crumb``, ``filler`` or ``content``. ``tokens``: those of the message, if they are known."""
    if _MAY_PART.search(message):
        parts = _PARTS.split(message.strip(" .|"))
        if len(parts) >= 2 and sum(" ".join(tokens_of(p)) in _nav_words() for p in parts) >= 0.6 * len(parts):
            return "crumb"
    if NAV_FORMS.fullmatch(message.strip(" .…!|:-*[]()")):
        return "crumb"
    tokens = tokens_of(message) if tokens is None else tokens
    if not tokens:
        return "content"
    text = " " + " ".join(tokens) + " "
    hits: dict[int, tuple[int, int, str]] = {}
    plain: list[str] | None = None
    for end, (key, what) in _automaton().iter(text):
        start = end - len(key) + 1
        for concept, words, exact in what:
            if exact is not None:
                plain = plain or _plain(message).split(" ")
                at = text.count(" ", 0, start + 1) - 1
                here = " ".join(plain[at : at + words])
                if here != exact and not (key[-1] != " " and here.startswith(exact)):
                    continue
            if concept == "strong":
                return "filler"
            old = hits.get(start)
            if old is None or words > old[0]:
                hits[start] = (words, end, concept)
    if not hits or all(h[2] == "past" for h in hits.values()):
        return "error" if len(tokens) == 2 and tokens[1] == "#" and tokens[0] in _HEAD else "content"
    n: dict[str, int] = {}
    score, until, first = 0.0, -1, None
    for start in sorted(hits):
        words, end, concept = hits[start]
        if start < until:  # within a longer phrase
            continue
        until = end if text[end] == " " else end + 1
        if concept != "past" and first is None:
            first = text.count(" ", 0, start + 1) - 1
        k = n[concept] = n.get(concept, 0) + 1
        if k <= 3:
            score += _WEIGHT[concept][0 if k == 1 else 1]
    headed = _headed(message)
    first = 0 if headed else first
    if first is None or first > NEAR:
        return "content"
    coded = "#" in tokens[:2] or any(a in _CODED and b == "#" for a, b in zip(tokens, tokens[1:]))
    score += (1.0 if coded else 0.0) + (1.5 if headed else 0.0)
    score += 0.5 if first <= 1 else 0.0
    notice = n.get("script", 0) and n.get("enable", 0)
    score += 1.5 if notice or (n.get("script", 0) and n.get("tech", 0)) else 0.0
    score -= 2.0 if len(tokens) > 30 else 1.0 if len(tokens) > 20 else 0.0
    if n.get("filler", 0) * 1.5 + 1.5 * n.get("past", 0) * -1 >= THRESHOLD:
        return "filler"
    solid = notice or any(n.get(c, 0) for c in ("plain", "tech", "fail", "filler"))
    several = (coded or headed) + len(n.keys() - {"past"}) > 1 or "plain" in n or "tech" in n  # a failure alone may be of anything
    if message[:1].islower() and not headed and len(tokens) > 4:
        score -= 1.0  # it may be the rest of a sentence
    several = several and ("past" not in n or bool(n.keys() & {"plain", "tech", "thing", "script", "filler"}))
    if score < THRESHOLD or not (solid or headed) or not several:
        return "content"
    if n.get("filler", 0) and not n.get("tech", 0) and not n.get("fail", 0):
        return "filler"
    return "script" if n.get("script", 0) else "error"


_HEADS = "error errors fatal warning exception problem notice fehler warnung erreur avertissement attention errore erro aviso fout http"
_HEAD = frozenset(tokens_of(_HEADS))
_EXACT_HEAD = frozenset(_HEADS.split())
_CODED = _HEAD | frozenset(tokens_of("status code ref reference id"))


def _headed(message: str) -> bool:
    """Whether one of the first words announces an error: 'Error:', 'fatal -', 'Warning!', 'Erreur 12'."""
    words = message.split(None, 5)[:5]
    reach = 4 if message[:1].isupper() or not message[:1].isalpha() else 1  # a message in small letters begins with it
    for i, w in enumerate(words[:reach]):
        if any(t in _HEAD and (len(t) >= CERTAIN or t in map(fold_word, _EXACT_HEAD & set(small_letters(w).split()))) for t in tokens_of(w)) and (w[-1] in ":!.–—-" or i + 1 == len(words) or words[i + 1][:1] in "#–—-:(" or words[i + 1][:1].isdigit()):
            return True
    return False


def leaf_of(message: str) -> str:
    """The leaf of a message in the tree of fixed depth: its number of words, then the first of them, folded."""
    return f"{message.count(' ') + 1} {folded(' '.join(message.split(' ', DEPTH)[:DEPTH]))}"


class Leaf:
    """The templates of one leaf. A message joins the template with the most equal tokens; where they differ the template has a gap."""

    SPLIT = 64  # templates from which a leaf looks its messages up by one more token

    def __init__(self, depth: int = DEPTH):
        self.depth = depth
        self.templates: list[list[str | None]] = []
        self.members: list[list[tuple[str, int, list[str]]]] = []
        self.below: dict[str, Leaf] = {}

    def add(self, tokens: list[str], message: str, n: int) -> None:
        best, at = -1, -1
        for i, t in enumerate(self.templates):
            same = sum(map(eq, t, tokens))
            if same > best:
                best, at = same, i
        if at >= 0 and best >= SIMILAR * len(tokens):
            self.templates[at] = [a if a == b else None for a, b in zip(self.templates[at], tokens)]
            self.members[at].append((message, n, tokens))
        elif len(self.templates) >= self.SPLIT and len(tokens) > self.depth:
            self.below.setdefault(tokens[self.depth], Leaf(self.depth + 1)).add(tokens, message, n)
        else:
            self.templates.append(list(tokens))
            self.members.append([(message, n, tokens)])

    def each(self) -> Iterator[list[tuple[str, int, list[str]]]]:
        """The members (message, count, tokens) of every template."""
        yield from self.members
        for leaf in self.below.values():
            yield from leaf.each()


def verdicts_of_leaf(rows: Iterable[tuple[str, int]]) -> Iterator[tuple[str, str, int]]:
    """(verdict, message, n) of the residue among the messages of one leaf.

    The messages are added in order of frequency; each template is classified
    once, by its most frequent message, and all its members get that verdict.
    """
    leaf = Leaf()
    rows = list(rows)
    for message, n in sorted(rows, key=lambda r: (-r[1], r[0])) if len(rows) > 1 else rows:
        leaf.add(tokens_of(message), message, n)
    for members in leaf.each():
        verdict = classify(members[0][0], members[0][2])
        if verdict != "content":
            for message, n, _ in members:
                yield verdict, message, n
