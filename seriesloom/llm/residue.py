"""Template residue, filler, error pages and script notices: a linear classifier on hashed n-grams with weak labels.

Texts are cut into sentences and these into overlapping windows of a few tokens. Phrases, placeholder forms and response statuses give weak
labels to the windows of all documents; a regularized logistic regression on hashed n-grams of tokens and of their
shapes, the tokens around the window, its length and its place is fitted on every window of every host that isn't kept for the threshold or for validation. It then scores every window of every text, and its probability
alone decides: a document is residue if one window reaches the threshold, which is chosen on documents of hosts that the fit never saw.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import blake2b
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.util import drop_stage, spread, stage

BITS = 19
WIDTH, STEP = 8, 4
#: Tokens on either side of a window that count as its surroundings.
AROUND = 8
#: Most tasks of a round of the fit, each of which sends one gradient (4 MB) to the driver.
FIT_TASKS = 64
L2, EPOCHS, RATE = 1e-6, 80, 0.05

# Names of fields, tags, filler words and phrases in the languages of the corpus.
TAGS = "p|br|i|b|u|em|strong|div|span|h[1-6]|ul|ol|li|a|table|tr|td|th|body|html|head|noscript|pre|code|blockquote|font|center|hr|img|sup|sub|small"
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
_LATIN = set(LATIN)
RARE_LATIN = _LATIN - {"sit", "sed", "do", "ut", "et", "ad", "in", "ex", "ea", "non", "qui", "id", "est", "esse", "dolor", "magna", "sint"}
FIELD = (
    r"(?:insert|enter|add|fill in|to be added|to be confirmed|tbc|tbd|ins[ée]rer|saisir|compl[ée]ter|à pr[ée]ciser|à compl[ée]ter|einf[üu]gen|eintragen|ausf[üu]llen|nachtragen"
    r"|insertar|introducir|completar|por definir|por completar)"
)
PLACEHOLDERS = [
    r"\{\{[^{}]*[^\W\d][^{}]*\}\}", r"\{%[^%{}]*[^\W\d][^%{}]*%\}", r"<%=?[^%<>]*[^\W\d][^%<>]*%>", r"[$#]\{[^{}]*[^\W\d][^{}]*\}", r"%\(\s*[^\W\d][^()]*\)s",
    r"@@[^@]*[^\W\d][^@]*@@", r"\[\[\s*(?!pp?\b|s\.|seite|page|p[áa]g)[^\W\d][^\[\]\d]{2,}\]\]", r"(?<![$#{%])\{\s*[^\W\d][\w ]{2,40}\s*\}(?!\})", r"%[^\W\d]\w{2,40}%",
    r"__(?=[^\W\d])(?:(?-i:[^\W\d_a-zà-ÿ]{3,}(?:_[^\W\d_a-zà-ÿ]+)*)|[^\W\d_]+(?:_[^\W\d_]+)+)__", r"«[^\W\d]\w{2,40}»",
    rf"\[(?=[^\[\]]*\b{FIELD})[^\[\]]{{3,60}}\]", rf"<(?=[^<>]*\b{FIELD})[^<>]{{3,60}}>", rf"<(?!/|(?:{TAGS})\b)\s*[^\W\d][\w ]{{2,40}}\s*>", r"\(\s*todo\b[^()]{0,60}\)",
]
STATUS = r"(?:4(?:0[0-9]|1[0-9]|2[0-9]|51)|5(?:0[0-9]|11|2[0-9]))"
ERROR_NAME = r"(?:bad request|unauthorized|forbidden|not found|gone|access denied|method not allowed|request timeout|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
ERRORS = [
    rf"\bhttp(?: status|/[12](?:\.\d)?)?[ -]+{STATUS}\b", rf"\berror {STATUS}\s*[:–-]", rf"\b(?:erreur|fehler|error) {STATUS}\s*[:–-]", rf"\b{STATUS}\s*[:–-]?\s+{ERROR_NAME}\b", rf"\b{ERROR_NAME}\s*\({STATUS}\)",
    rf"\b(?:zugriff verweigert|acc[èe]s refus[ée]|acceso denegado|seite nicht gefunden|page introuvable|p[áa]gina no encontrada|nicht gefunden|introuvable|no encontrad[ao])\s*\({STATUS}\)",
    r"\brequested url was not found\b", r"\bpage you (?:were looking for|requested)\b", r"\b(?:transcript|page|document|record|speech) you requested could not be (?:loaded|found|displayed)", r"\bdo not have permission to (?:view|access|see|read)\b",
    r"\bsession has expired\W+please\b", r"\byour session has expired\.?$", r"\bplease log in again\b", r"\bupstream timed out\b", r"\b(?:database|db) (?:connection|query) failed\b", r"\btoo many connections\b", r"\bretry in \d+ seconds\b",
    r"\bsomething went wrong\b", r"\ban? (?:unexpected )?error (?:has )?occurred\b", r"\berreur est survenue\b", r"\bfehler aufgetreten\b", r"\bocurrido un error\b", r"\btry again later or contact\b", r"\btemporarily offline\b", r"\bundefined (?:index|variable|offset)\b", r"\btraceback\b[^.]{0,40}(?:\berror\b|loader|recent call|line)", r"\b(?:key|value|type|index|attribute|nullpointer|runtime)error\b|\bexception in thread\b|\bstack ?trace\b",
    r"\berreur interne du serveur\b", r"\bpage demand[ée]e n'existe plus\b", r"\bpage demand[ée]e (?:est|n')", r"\bservice est momentan[ée]ment indisponible\b", r"\bveuillez r[ée]essayer plus tard\b", r"\bsession a expir[ée],? veuillez\b", r"\bveuillez vous reconnecter\b",
    r"\binterner serverfehler\b", r"\bversuchen sie es sp[äa]ter (?:erneut|noch einmal)\b", r"\bangeforderte (?:seite|url|dokument)\b", r"\bdienst (?:ist )?(?:vor[üu]bergehend|derzeit|zurzeit|momentan) nicht (?:verf[üu]gbar|erreichbar)\b", r"\bsitzung ist abgelaufen,? bitte\b", r"\bmelden sie sich (?:bitte )?(?:erneut|wieder|neu) an\b", r"\bkeine berechtigung\b",
    r"\berror interno del servidor\b", r"\bp[áa]gina solicitada no existe\b", r"\bservicio no est[áa] disponible temporalmente\b", r"\bsesi[óo]n ha caducado,? vuelva\b", r"\bvuelva a iniciar sesi[óo]n\b", r"\bint[ée]ntelo (?:de nuevo )?m[áa]s tarde\b",
]
ALONE = rf"^\W*(?:(?:error|fehler|erreur)\W*)?(?:{STATUS}\W*)?(?:{ERROR_NAME}|zugriff verweigert|acc[èe]s refus[ée]|acceso denegado|page introuvable|seite nicht gefunden|p[áa]gina no encontrada)(?:\W*{STATUS})?\W*$"
JS = r"(?:java ?scripts?|scripts?|js|skripte|scripting)"
SCRIPTS = [
    rf"\bplease (?:enable|activate|turn on|allow) (?:your )?{JS}\b", rf"\bneed to (?:enable|activate|turn on|allow) {JS}\b", rf"\b{JS} (?:is|are|appears to be|must be) (?:currently )?(?:disabled|turned off|required|enabled|not enabled|needed)\b", rf"\b(?:page|site|app|application|viewer)\b[^.]{{0,20}} (?:requires?|needs?) (?:active )?{JS}\b",
    rf"\bnecessary to (?:activate|enable) {JS}\b", rf"\b(?:does not|doesn't|cannot) (?:support|run|execute) {JS}\b", r"\bnoscript:", r"\bneeds active scripting\b", r"\bturn it on in your browser\b", r"\benable cookies and reload\b", r"\btranscript cannot be shown\b",
    rf"\bveuillez activer {JS}\b(?! ?»)", rf"\bpage n[ée]cessite {JS}\b", rf"\b{JS} est d[ée]sactiv[ée]", rf"\bnavigateur n'ex[ée]cute pas les {JS}", rf"\bactivez {JS}\b",
    rf"\bbitte (?:aktivieren|erlauben) sie {JS}\b(?!«)", rf"\bseite (?:ben[öo]tigt|braucht|erfordert) {JS}\b", rf"\b{JS} (?:ist|sind) in ihrem browser\b", rf"\bbrowser f[üu]hrt keine {JS} aus\b", rf"\b{JS} aktivieren,? um\b",
    rf"\b(?:p[áa]gina|sitio) (?:requiere|necesita) {JS}\b", rf"\bactive {JS} para (?:ver|mostrar|leer|usar)\b", rf"\b{JS} est[áa] (?:desactivado|deshabilitado)", rf"\bnavegador no ejecuta {JS}\b", rf"\bhabilite {JS}\b",
]
FILLERS = [
    r"\b(?:your|you) (?:text|heading|title|content|speech) (?:goes )?here\b", r"\btext (?:goes here|to follow)\b", r"\binsert (?:remarks|text|content|speech|title) here\b", r"\b(?:heading|draft) goes here\b", r"\bplaceholder (?:paragraph|text|copy)\b", r"\bfor layout purposes\b", r"\b(?:dummy|filler) (?:copy|text)\b",
    r"\b(?:sample|example) (?:text|speech)\b[^.]{0,60}(?:replace|testing|layout|\.?$)", r"\breplace it with the transcript\b", r"\bbody text(?: body text)+", r"\bbla(?:h)?(?:[ ,]+bla(?:h)?){2,}", r"\btest(?:[ ,]+(?:test|\d+)){2,}", r"(?:\bx{3,}\b[ ,.]*){3,}", r"\b(?:asdf|jklö|qwert[yz]|foo bar)\b",
    r"\bvotre (?:texte|titre) ici\b", r"\btexte d'exemple\b", r"\btexte provisoire\b", r"\bfaux[- ]texte\b[^.]{0,20}(?:remplacer|ici)", r"\btexte (?:à venir|de remplissage)\b", r"\bà remplacer par le compte rendu\b",
    r"\bmustertext(?:\W+mustertext)+", r"\bplatzhaltertext\b", r"\bdies ist ein (?:blind|muster|platzhalter|beispiel)text\b", r"\bhier steht (?:sp[äa]ter|dann|bald)\b", r"\b(?:ihr|ihren) text hier\b", r"\bdurch das protokoll ersetzen\b", r"\btext folgt\b", r"\bblindtext(?:\W+blindtext)+",
    r"\bsu (?:texto|t[íi]tulo) aqu[íi]\b", r"\btexto provisional\b", r"\btexto de ejemplo\b", r"\btexto de relleno\b(?! que)", r"\bsustit[úu]yalo por la transcripci[óo]n\b", r"\btexto pendiente\b",
]
#: Examples of the phrases and forms above, and frames in which somebody only quotes them: weakly labelled texts for corpora that show few.
EXAMPLES = [
    "Dear {{ name }}, welcome.", "<%= heading %>", "${author} spoke on #{date}.", "By {author} on {date}.", "%(place)s", "@@DATE@@", "[[heading]]", "%DATE%", "%AUTHOR% spoke on %PLACE%.", "__NAME__ spoke.", "«Name», «Date»", "[insert name here]", "<name to be added>", "(TODO: name)", "[nom à compléter]", "[Name einfügen]", "[insertar nombre]", "{% block %}", "On <date> in <PLACE>.", "Am <datum> in {Ort}.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Sed ut labore et dolore magna aliqua.", "Your text here.", "Your title goes here.", "Insert text here.", "This is placeholder text.", "Sample text, please replace.", "Dummy text for layout purposes.", "Body text body text body text.", "blah blah blah", "test test test", "xxx xxx xxx xxx", "asdf asdf", "Votre texte ici.", "Texte provisoire.", "Texte de remplissage.", "Mustertext Mustertext.", "Platzhaltertext.", "Hier steht später der Text.", "Ihr Text hier.", "Text folgt.", "Su texto aquí.", "Texto de ejemplo.", "Texto provisional.",
    "HTTP Status 404 – Not Found", "HTTP/1.1 500 Internal Server Error", "Error 403: Forbidden", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout", "Access denied (403)", "405 Method Not Allowed", "The requested URL was not found.", "The page you requested could not be found.", "You do not have permission to view this page.", "Your session has expired, please log in again.", "Something went wrong.", "An unexpected error occurred.", "Database connection failed.", "The service is temporarily offline.", "Traceback: KeyError", "Erreur 500 : erreur interne du serveur", "Page introuvable (404)", "Accès refusé (403)", "La page demandée n'existe plus.", "Veuillez réessayer plus tard.", "Votre session a expiré, veuillez vous reconnecter.", "Fehler 500: Interner Serverfehler", "Seite nicht gefunden (404)", "Zugriff verweigert (403)", "Bitte versuchen Sie es später erneut.", "Ihre Sitzung ist abgelaufen, bitte melden Sie sich erneut an.", "Error 500: error interno del servidor", "Página no encontrada (404)", "Acceso denegado (403)", "Inténtelo de nuevo más tarde.", "Su sesión ha caducado, vuelva a iniciar sesión.",
    "Please enable JavaScript to continue.", "You need to enable JavaScript to use this app.", "This page requires JavaScript.", "JavaScript is disabled in your browser.", "Your browser does not support scripts.", "Veuillez activer JavaScript pour continuer.", "Cette page nécessite JavaScript.", "JavaScript est désactivé.", "Bitte aktivieren Sie JavaScript, um fortzufahren.", "Diese Seite benötigt JavaScript.", "JavaScript ist in Ihrem Browser deaktiviert.", "Active JavaScript para continuar.", "Esta página requiere JavaScript.", "JavaScript está desactivado.",
]
FRAMES = ['"{}", it said, and nobody knew why.', "The screen said “{}” to all of them.", "« {} », disait l'écran.", "»{}«, stand auf dem Schirm.", "La pantalla decía «{}» a todos."]
#: Quoted stretches, and the words that a sentence has besides one if it quotes instead of being a notice in quotation marks.
QUOTED = ['"[^"]*"', "«[^«»]*»", "»[^«»]*«", "„[^„“”]*[“”]", "“[^“”]*”"]
BESIDES = 3
#: Verbs by which a sentence reports what somebody said or what stood somewhere.
REPORT = [
    r"\b(?:said|says|told|wrote|writes|admitted|reported|claimed|called|asked|answered|announced|noted|heard|hears|saw|had|held|contained|stood|received|showed|printed)\b",
    r"\b(?:dit|disait|[ée]crivait|affichait|contenait|portait|indiquait|r[ée]pondait|admis|avouait|figurait|restait|lisait|avait|montrait)\b",
    r"\b(?:sagte|sagt|schrieb|stand|hieß|enthielt|zeigte|meldete|einr[äa]umte|nannte|antwortete|berichtete|erkl[äa]rte|hatte)\b",
    r"\b(?:dijo|dice|dec[íi]a|ten[íi]a|conten[íi]a|mostraba|admiti[óo]|escribi[óo]|le[íi]a|respondi[óo]|inform[óo]|figuraba|llam[óo]|pon[íi]a|hab[íi]a)\b",
]
#: Words of which every phrase and form has one: other sentences aren't searched for marks.
TRIGGERS = set(
    "java javascript javascripts script scripts js skripte noscript scripting http error erreur fehler keyerror valueerror typeerror indexerror attributeerror runtimeerror traceback stacktrace stack exception status forbidden gateway found page"
    " permission session sesión sesion sitzung log upstream database db connections retry try offline undefined unauthorized request requests timeout service serverfehler serveur indisponible réessayer reessayer reconnecter versuchen angeforderte dienst melden"
    " berechtigung página pagina servicio servidor iniciar inténtelo intentelo denied zugriff verweigert accès acces refusé refuse acceso denegado seite introuvable gefunden encontrada turn cookies transcript document record text heading title content draft remarks"
    " placeholder layout dummy filler sample example replace body bla blah test asdf jklö qwerty qwertz foo votre texte mustertext platzhaltertext blindtext mustertext dies hier ihr ihren texto título titulo sustitúyalo sustituyalo insert enter add fill added confirmed"
    " tbc tbd todo insérer inserer saisir compléter completer préciser preciser einfügen einfugen eintragen ausfüllen nachtragen insertar introducir completar definir wrong gone activer activez aktivieren active habilite remplacer protokoll occurred survenue aufgetreten ocurrido allowed implemented speech encontrado nullpointererror ausfullen".split()
) | RARE_LATIN

_any = lambda parts: re.compile("|".join(f"(?:{p})" for p in parts), re.I)


@cache
def _rules() -> dict[str, re.Pattern]:
    return {"template": _any(PLACEHOLDERS), "error": _any([*ERRORS, ALONE]), "scripts": _any(SCRIPTS), "filler": _any(FILLERS), "quoted": _any(QUOTED), "report": _any(REPORT)}


_MOJI = re.compile("[ÂÃ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-™]")
_TAG = re.compile(rf"</?(?:{TAGS})\b[^<>]*>", re.I)
_TITLE = re.compile(r"<title>(.*?)</title>", re.I | re.S)
#: Titles and other words after which a full stop ends no sentence.
ABBREVIATIONS = {"mr", "mrs", "ms", "dr", "abg", "mme", "m", "sr", "sra", "st", "nr", "no", "p", "pp", "s", "art", *"abcdefghijklmnopqrstuvwxyz"}
#: Words, numbers, underscores, and signs with the blank that follows them.
_TOKEN = re.compile(r"[^\W\d_]+|\d+|_+|[^\w\s]+ ?")
_SPACE = re.compile("[\\s  -  　]+")


def _remade(m: re.Match) -> str:
    try:
        return m.group(0).encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return m.group(0).encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m.group(0)


def clean(text: str) -> str:
    """One line of text: wrong decoding mended, entities read, tags and paragraph ends as a mark, blanks single."""
    t = html.unescape(text) if "&" in text else text
    if "&" in t:
        t = re.sub(r"&(lt|gt|amp|quot);", lambda m: html.unescape(m.group(0).lower()), t, flags=re.I)
    if "Ã" in t or "Â" in t:
        t = _MOJI.sub(_remade, t)
    t = t.replace("­", "").replace("​", "").replace("﻿", "")
    t = re.sub(r"\n\s*\n", " ¶ ", t)
    if "<" in t:
        t = _TITLE.sub(r" ¶ \1 ¶ ", t)
        t = _TAG.sub(" ¶ ", t)
    return _SPACE.sub(" ", t).strip()


def triggered(words: list[str]) -> bool:
    """Whether a sentence has a word or sign without which it can't hold residue."""
    return any(map(_trigger, words))


@cache
def _trigger(w: str) -> bool:
    return w in TRIGGERS or not w[0].isalnum() and any(c in w for c in "{<@%«_") or "[[" in w or w.strip("x") == ""


def talked_about(sentence: str, x: int, y: int) -> bool:
    """Whether the phrase from x to y is quoted beside other words, or is, in small letters, part of a longer clause that reports."""
    r = _rules()
    for m in r["quoted"].finditer(sentence):
        if m.start() <= x and y <= m.end() and len(re.findall(r"[^\W\d_]+", sentence[: m.start()] + " " + sentence[m.end() :])) >= BESIDES:
            return True
    inside = sentence[x].islower() and re.search(r"[^\W\d_] $", sentence[:x]) is not None
    return inside and r["report"].search(sentence[:x] + " | " + sentence[y:]) is not None


def spans(sentence: str) -> list[tuple[int, int, str]]:
    """Places in a sentence that look like residue, with their kind; phrases that are only talked about are none."""
    if not triggered([t for _, _, t in tokens(sentence)]):
        return []
    r = _rules()
    found = [(*m.span(), "template") for m in r["template"].finditer(sentence)]
    for kind in ("error", "scripts", "filler"):
        found += [(*m.span(), kind) for m in r[kind].finditer(sentence) if not talked_about(sentence, *m.span())]
    run: list[tuple[int, int, str]] = []
    for m in [*re.finditer(r"[^\W\d_]+", sentence), None]:
        w = m.group(0).lower() if m else ""
        if w in _LATIN:
            run.append((*m.span(), w))
        else:
            if len(run) >= 4 and sum(x[2] in RARE_LATIN for x in run) >= 3:
                found.append((run[0][0], run[-1][1], "filler"))
            run = []
    return found


def tokens(sentence: str) -> list[tuple[int, int, str]]:
    """Words, signs and numbers (all written 9) in small letters, with their places."""
    return [(m.start(), m.end(), "9" if m.group(0)[0].isdigit() else m.group(0).rstrip().lower()) for m in _TOKEN.finditer(sentence)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hash(w: str) -> int:
    return int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")


class _Words(dict):
    """Token to (hash of its small letters, hash of its shape, whether it may end a sentence or is an abbreviation, whether it is a trigger), as one row of ``rows``."""

    MOST = 500_000  # bounds the memory of a worker, not the result

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, int, int, int]] = []

    def __missing__(self, w: str) -> int:
        bare = w.rstrip()
        word = "9" if w[0].isdigit() else bare.lower()
        if w[0].isdigit():
            shape = "9"
        elif w[0].isalpha():
            shape = "A" if len(bare) > 1 and bare.isupper() else "Aa" if w[0].isupper() else "a"
        else:
            shape = bare
        mark = 1 if w[0] == "¶" or bare.startswith("***") or (w[-1] == " " and bare.rstrip("\"»”)]*").endswith((".", "!", "?"))) else 2 if word in ABBREVIATIONS else 0
        if mark == 1 and bare == ".":
            mark = 3  # a full stop, which an abbreviation keeps from ending the sentence
        self[w] = len(self.rows)
        self.rows.append((_hash(word), _hash("shape " + shape), mark, int(_trigger(word))))
        return self[w]


_WORDS = _Words()


class Tokenized:
    """Tokens of many texts as arrays: hashes, shapes, and the sentences and windows that they form."""

    def __init__(self, texts: list[str | None]) -> None:
        global _WORDS
        if len(_WORDS) > _Words.MOST:
            _WORDS = _Words()
        self.clean = [clean(t) if t else "" for t in texts]
        words = [_TOKEN.findall(t) for t in self.clean]
        size = np.array([len(x) for x in words], np.int64)
        number = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(words)), np.int64, int(size.sum()))
        n = len(number)
        self.doc = np.repeat(np.arange(len(texts)), size)
        rows = np.array(_WORDS.rows, np.uint64).reshape(-1, 4)
        self.word, self.shape, mark, self.trigger = (x[number] for x in rows.T)
        last = np.zeros(n, bool)
        last[np.cumsum(size)[size > 0] - 1] = True
        after_short = np.zeros(n, bool)
        after_short[1:] = (mark[:-1] == 2) & ~last[:-1]
        ends = np.flatnonzero(last | (mark == 1) | ((mark == 3) & ~after_short))
        self.begin = np.r_[0, ends[:-1] + 1].astype(np.int64) if len(ends) else np.zeros(0, np.int64)  # of each sentence
        self.end = ends + 1
        k = self.end - self.begin
        self._cut()
        self.owner = self.doc[self.a] if n else np.zeros(0, np.int64)
        opening = np.ones(len(k), bool)
        if len(k):
            opening[1:] = self.doc[self.begin[1:]] != self.doc[self.begin[:-1]]
        upper = np.r_[0, np.cumsum(self.shape == np.uint64(_hash("shape A")))]
        lower = np.r_[0, np.cumsum((self.shape == np.uint64(_hash("shape a"))) | (self.shape == np.uint64(_hash("shape Aa"))))]
        caps = (upper[self.end] - upper[self.begin] > 1) & (lower[self.end] == lower[self.begin])
        self.extra = _mix(np.uint64(_hash("window")) + (self.b - self.a).astype(np.uint64) * np.uint64(8) + (opening & (k <= 12))[self.sentence].astype(np.uint64) * np.uint64(2) + caps[self.sentence].astype(np.uint64))
        self.extra >>= np.uint64(64 - BITS)

    def _cut(self) -> None:
        """Windows of the sentences: the sentence, begin and end of each."""
        k = self.end - self.begin
        each = np.where(k <= WIDTH, 1, -(-(k - STEP) // STEP))
        self.sentence = np.repeat(np.arange(len(k)), each)
        self.a = self.begin[self.sentence] + (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * STEP
        self.b = np.minimum(self.a + WIDTH, self.end[self.sentence])

    def pack(self, label: np.ndarray) -> bytes:
        """Features of the tokens, numbered within these texts, with the sentences and the windows' labels, for :class:`Packed`."""
        grams, (around, _, _) = self.grams(), self.around()
        every = np.concatenate([*[f for f, _ in grams], around, self.extra.astype(np.int64)])
        seen = np.zeros(1 << BITS, bool)
        seen[every] = True
        parts = [np.array([len(self.doc), np.count_nonzero(seen), len(self.begin), len(label)]), np.flatnonzero(seen), self.begin, (np.cumsum(seen) - 1)[every], label]
        raw = b"".join(np.ascontiguousarray(x, np.int32).tobytes() for x in parts)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    def grams(self) -> list[tuple[np.ndarray, int]]:
        """Feature number of the grams that start at each token, and their length, over tokens and shapes."""
        shift, out = np.uint64(64 - BITS), []
        with np.errstate(over="ignore"):
            for salt, x, least in ((1, self.word, 1), (2, self.shape, 2)):
                w = np.concatenate([x * np.uint64(2 * salt + 1), np.zeros(2, np.uint64)])
                two = w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]
                three = two[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:]
                for length, h in ((1, w), (2, two), (3, three)):
                    if length >= least:
                        out.append(((_mix(h[: len(x)]) >> shift).astype(np.int64), length))
        return out

    def around(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature number of each token as part of a window's surroundings, and where these begin and end for each window."""
        with np.errstate(over="ignore"):
            f = (_mix(self.word * np.uint64(0x2545F4914F6CDD1D) + np.uint64(11)) >> np.uint64(64 - BITS)).astype(np.int64)
        return f, np.maximum(self.begin[self.sentence], self.a - AROUND), np.minimum(self.end[self.sentence], self.b + AROUND)

    def probability(self, w: np.ndarray, bias: float) -> np.ndarray:
        """Probability of each window."""
        total = lambda f: np.concatenate([[0.0], np.cumsum(w[f], dtype=float)])
        z = bias + w[self.extra.astype(np.int64)].astype(float)
        for f, length in self.grams():
            c = total(f)
            z += c[np.maximum(self.b - length + 1, self.a)] - c[self.a]
        f, lo, hi = self.around()
        c = total(f)
        return 1 / (1 + np.exp(-np.clip(z + c[hi] - c[lo], -30, 30)))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each token begins and ends in its cleaned text."""
        spots = [m.span() for t in self.clean for m in _TOKEN.finditer(t)]
        s = np.array(spots, np.int64).reshape(-1, 2)
        return s[:, 0], s[:, 1]

    def sentence_of(self, window: int) -> str:
        """Text of the sentence of a window."""
        i = self.sentence[window]
        d = self.doc[self.begin[i]]
        past = np.searchsorted(self.doc, d)
        spots = [m.span() for m in _TOKEN.finditer(self.clean[d])]
        return self.clean[d][spots[self.begin[i] - past][0] : spots[self.end[i] - past - 1][1]].strip()

    def text_of(self, sentence: int, start: np.ndarray, stop: np.ndarray) -> str:
        return self.clean[self.doc[self.begin[sentence]]][start[self.begin[sentence]] : stop[self.end[sentence] - 1]]


def sentences(text: str) -> list[str]:
    """Sentences of a text after :func:`clean`; abbreviations end none."""
    t = Tokenized([text])
    start, stop = t.places()
    return [x.strip() for i in range(len(t.begin)) if (x := t.text_of(i, start, stop).strip(" ¶"))]


def labelled(t: Tokenized) -> tuple[np.ndarray, np.ndarray]:
    """For each window its label (1 where it overlaps a weakly labelled stretch), and the kind of each document ('' without residue)."""
    label, kinds = np.zeros(len(t.a), int), np.full(len(t.clean), "", object)
    if not len(t.a):
        return label, kinds
    hot = np.flatnonzero(np.add.reduceat(t.trigger, t.begin))  # sentences with a trigger; no others have marks
    first, past = np.searchsorted(t.sentence, hot), np.searchsorted(t.sentence, hot, side="right")
    known, before, spots = -1, 0, []
    for i, lo, hi in zip(hot.tolist(), first.tolist(), past.tolist(), strict=True):
        if (d := int(t.doc[t.begin[i]])) != known:
            known, before, spots = d, int(np.searchsorted(t.doc, d)), [m.span() for m in _TOKEN.finditer(t.clean[d])]
        at = spots[t.begin[i] - before][0]
        marks = spans(t.clean[d][at : spots[t.end[i] - 1 - before][1]])
        if not marks:
            continue
        kinds[d] = kinds[d] or marks[0][2]
        for j in range(lo, hi):
            start, stop = spots[t.a[j] - before][0] - at, spots[t.b[j] - 1 - before][1] - at
            label[j] = any(min(y, stop) - max(x, start) >= min(8, y - x) for x, y, _ in marks)
    return label, kinds


class Packed(Tokenized):
    """What :meth:`Tokenized.pack` wrote, with the sums over windows and features that a fit needs."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd"), np.int32)
        n, features, sentences_, windows = raw[:4].tolist()
        self.size, (self.own, self.begin, at, self.label) = n, (x.astype(np.int64) for x in np.split(raw[4:], np.cumsum([features, sentences_, 6 * n + windows])))
        self.end = np.append(self.begin[1:], n)
        self._cut()
        each = [at[i * n : (i + 1) * n] for i in range(6)]
        bounds = [(self.a, self.b), *[(self.a, np.maximum(self.b - k, self.a)) for k in (1, 2)]]
        lo, hi = np.maximum(self.begin[self.sentence], self.a - AROUND), np.minimum(self.end[self.sentence], self.b + AROUND)
        self.parts = [*[(f, *bounds[length - 1]) for f, length in zip(each, (1, 2, 3, 2, 3), strict=False)], (each[5], lo, hi)]  # as grams() and around() have them
        self.extra = at[6 * n :]

    def scores(self, w: np.ndarray) -> np.ndarray:
        """Sum of the weights of each window's features."""
        w, c = w[self.own], np.zeros(self.size + 1)
        z = w[self.extra]
        for f, lo, hi in self.parts:
            np.cumsum(w.take(f, mode="clip"), out=c[1:])
            z += c.take(hi, mode="clip") - c.take(lo, mode="clip")
        return z

    def add(self, d: np.ndarray, to: np.ndarray) -> None:
        """Adds to each feature the numbers ``d`` of the windows that hold it, as often as they do."""
        total = np.bincount(self.extra, d, len(self.own))
        begins = np.bincount(self.a, d, self.size + 1)
        for f, lo, hi in self.parts:
            each = (begins if lo is self.a else np.bincount(lo, d, self.size + 1)) - np.bincount(hi, d, self.size + 1)
            total += np.bincount(f, np.cumsum(each)[:-1], len(total))
        to[self.own] += total


def packed(docs: DataFrame, text: str, host: str) -> DataFrame:
    """(x) all windows of all documents for fitting with their weak labels, packed (:meth:`Tokenized.pack`) up to 500 documents at a time; staged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for lo in range(0, len(part), 500):
                t = Tokenized(list(part["t"].iloc[lo : lo + 500]))
                if len(t.a):
                    yield pd.DataFrame({"x": [t.pack(labelled(t)[0])]})

    x = spread(docs.where((fold(F.col(host)) == 2) & F.col(text).isNotNull()).select(F.col(text).alias("t")))
    return stage(x.mapInPandas(run, "x binary"))


def examples() -> Packed:
    """The windows of the example notices, and of the frames that quote them."""
    t = Tokenized([*EXAMPLES, *[f.format(e) for e in EXAMPLES for f in FRAMES]])
    return Packed(t.pack(t.owner < len(EXAMPLES)))


def _sums(blocks: DataFrame, each: Callable[[Packed, np.ndarray], None], size: int, more: Packed, kept: Broadcast | None = None) -> np.ndarray:
    """Sum over all blocks and ``more`` of the ``size`` numbers that ``each`` adds to its second argument, of which those at ``kept`` come from each task as one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size)
        for b in batches:
            for x in b.column(0):
                each(Packed(x.as_py()), own)
        yield pa.RecordBatch.from_arrays([pa.array([(own if kept is None else own[kept.value]).tobytes()], pa.binary())], ["g"])

    total = np.zeros(size)
    each(more, total)
    total = total if kept is None else total[kept.value]
    tasks = min(blocks.sparkSession.sparkContext.defaultParallelism, FIT_TASKS)
    for g in blocks.coalesce(tasks).mapInArrow(run, "g binary").toArrow()["g"]:
        total += np.frombuffer(g.as_buffer())
    return total


def fit(blocks: DataFrame, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """L2-regularized logistic regression (weights, bias) on all windows of :func:`packed` tables and the examples, both classes weighing the same. Every round reads all windows where they are; one gradient comes from each task."""
    size, more = 1 << BITS, examples()

    def count(x: Packed, own: np.ndarray) -> None:
        x.add(np.ones(len(x.label)), own[2:])
        own[:2] += len(x.label), x.label.sum()

    n, positive, *_ = counts = _sums(blocks, count, size + 2, more)
    w, bias = np.zeros(size), 0.0
    if n == len(more.label) or not 0 < positive < n:
        return w.astype(np.float32), -10.0
    used = np.flatnonzero(np.rint(counts[2:]) > 1)  # what occurs once tells nothing of other windows
    share = np.array([0.5 / (n - positive), 0.5 / positive])
    context = blocks.sparkSession.sparkContext
    kept, v = context.broadcast(np.r_[0, used + 1]), np.zeros(len(used))
    m1, m2, b1, b2 = np.zeros_like(v), np.zeros_like(v), 0.0, 0.0
    for t in range(1, epochs + 1):
        w[used] = v
        now = context.broadcast((w, bias))  # 4 MB, whatever the corpus

        def gradient(x: Packed, own: np.ndarray, now: Broadcast = now) -> None:
            w, bias = now.value
            d = (1 / (1 + np.exp(-np.clip(x.scores(w) + bias, -30, 30))) - x.label) * share[x.label]
            x.add(d, own[1:])
            own[0] += d.sum()

        g = _sums(blocks, gradient, size + 1, more, kept)
        now.destroy()
        g, d = g[1:] + L2 * v, g[0]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * d, 0.999 * b2 + 0.001 * d**2
        v -= RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        bias -= RATE * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.999**t)) + 1e-8)
    w[used] = v
    kept.destroy()
    return w.astype(np.float32), float(bias)


def fold(host: Column) -> Column:
    """0: hosts kept for validation, 1: hosts on which the threshold is chosen (a tenth each, by hash), 2: hosts for fitting."""
    return F.least(F.pmod(F.xxhash64(F.coalesce(host.cast("string"), F.lit(""))), F.lit(10)), F.lit(2)).cast("int")


def best_threshold(y: np.ndarray, p: np.ndarray) -> float:
    """Threshold of the best F1 on labelled documents, between the last probability above it and the first below; one half without any residue."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    score = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    score[:-1][p[order][:-1] == p[order][1:]] = -1  # equal probabilities fall on one side
    k = int(np.flatnonzero(score == score.max())[-1])
    logit = lambda x: np.log(max(x, 1e-12) / max(1 - x, 1e-12))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(1 / (1 + np.exp(-(logit(p[order][k]) + logit(below)) / 2)))


def best_windows(x: DataFrame, w: np.ndarray, bias: float, least: float, cols: str) -> DataFrame:
    """The columns named in ``cols``, p and sentence of every document (column t) whose most certain window reaches ``least``; the rows stay where they are."""
    share = x.sparkSession.sparkContext.broadcast(w)  # 2 MB, whatever the corpus
    names = [c.split(" ")[0] for c in cols.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for lo in range(0, len(part), 500):
                b = part.iloc[lo : lo + 500]
                t = Tokenized(list(b["t"]))
                top, at = np.zeros(len(b)), np.zeros(len(b), np.int64)
                if len(t.a):
                    p = t.probability(share.value, bias)
                    first = np.flatnonzero(np.r_[True, t.owner[1:] != t.owner[:-1]])
                    most = np.maximum.reduceat(p, first)
                    has = t.owner[first]
                    top[has] = most
                    best = np.flatnonzero(p == np.repeat(most, np.diff(np.r_[first, len(p)])))
                    at[t.owner[best][::-1]] = best[::-1]
                hit = np.flatnonzero(top >= least)
                if not len(hit):
                    continue
                out = b.iloc[hit][names].copy()
                out["p"] = top[hit]
                out["sentence"] = [t.sentence_of(at[k]) if top[k] > 0 else "" for k in hit]
                yield out

    return x.mapInPandas(run, f"{cols}, p double, sentence string")


def train(docs: DataFrame, text: str, host: str) -> tuple[np.ndarray, float, float]:
    """(weights, bias, threshold): fitted on the weakly labelled windows of all documents but those of the hosts kept for the threshold and for validation; the threshold is the best for all documents of the hosts kept for it.
    What reaches the driver is a gradient from each task and one label and probability for each of these last documents."""
    blocks = packed(docs, text, host)
    w, bias = fit(blocks)
    drop_stage(blocks)
    share = docs.sparkSession.sparkContext.broadcast(w)  # 2 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for lo in range(0, len(part), 500):
                t = Tokenized(list(part["t"].iloc[lo : lo + 500]))
                top = np.zeros(len(t.clean))
                if len(t.a):
                    np.maximum.at(top, t.owner, t.probability(share.value, bias))
                yield pd.DataFrame({"y": labelled(t)[1] != "", "p": top})

    x = spread(docs.where((fold(F.col(host)) == 1) & F.col(text).isNotNull()).select(F.col(text).alias("t")))
    seen = x.mapInPandas(run, "y boolean, p double").toPandas()
    return w, bias, best_threshold(seen["y"].to_numpy(bool), seen["p"].to_numpy(float))


def kind_of(sentence: str) -> str:
    """Kind of the phrase or form in a sentence, for the report only; ``other`` where none of the lists knows it."""
    return (spans(sentence) or [(0, 0, "other")])[0][2]


def residue(docs: DataFrame, ident: str, text: str, host: str) -> DataFrame:
    """(id, p, sentence) of every document with a window whose probability reaches the threshold: its most certain window's.

    Null and empty texts have none. The whole text of every document is read. A corpus without any weakly labelled window gives no rows.
    """
    w, bias, threshold = train(docs, text, host)
    kind = docs.schema[ident].dataType.simpleString()
    x = spread(docs.select(F.col(ident).alias("i"), F.col(text).alias("t")))
    return best_windows(x, w, bias, threshold, f"i {kind}").withColumnRenamed("i", ident)


def validation(docs: DataFrame, ident: str, text: str, host: str) -> DataFrame:
    """Documents of the hosts that neither the fit nor the choice of the threshold saw, by their weak label (``none`` without one) and the label of their windows.

    n_documents have such windows, n_found of them one that reaches the threshold; n_windows and n_flagged are the same for the windows.
    """
    w, bias, threshold = train(docs, text, host)
    share = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for lo in range(0, len(part), 500):
                t = Tokenized(list(part["t"].iloc[lo : lo + 500]))
                if not len(t.a):
                    continue
                label, kinds = labelled(t)
                hit = t.probability(share.value, bias) >= threshold
                x = pd.DataFrame({"d": t.owner, "kind": np.where(kinds == "", "none", kinds)[t.owner], "label": label, "hit": hit.astype(int)})
                yield x.groupby(["d", "kind", "label"], as_index=False).agg(windows=("hit", "size"), flagged=("hit", "sum"))[["kind", "label", "windows", "flagged"]]

    x = spread(docs.where((fold(F.col(host)) == 0) & F.col(text).isNotNull()).select(F.col(text).alias("t")))
    y = x.mapInPandas(run, "kind string, label int, windows long, flagged long")
    count = [F.count("*").alias("n_documents"), F.sum((F.col("flagged") > 0).cast("long")).alias("n_found"), F.sum("windows").alias("n_windows"), F.sum("flagged").alias("n_flagged")]
    return y.groupBy("kind", "label").agg(*count)
