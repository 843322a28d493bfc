"""Problem 9: template residue, filler, error pages and script notices in documents.

Every document is cut into messages (lines and sentences) after code, quotations and formulas, which only show such things,
are taken out. Numbers, addresses, dates and ids in every message are masked, and equal masked messages are grouped by an exact
hash over all documents and sources, whatever they say. Groups are classified by how they are told (`route`):

- `recurring`: a message in several documents of several sources (`least_documents`, `least_sources`) whose words are mostly
  those of one kind (WORDS_OF), or that one of the weaker phrase rules (WEAK) matches;
- `phrase`: a message that one of the phrase rules (RULES) matches, which nothing but such a message says, however rare it is;
- `slot`: a placeholder. Syntaxes that nothing but templates uses count always; those that ordinary text uses too (`<x>`, `{x}`,
  `#x#`, `«x»`) count only with a slot name that occurs in the former, anywhere in the corpus.

Defined results: null, empty and blank texts hold nothing; a document can have several kinds, each once; repeated rows are
reported each by their own id; null sources are one source; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import MOST_BROADCAST, WORD, clean, cut, map_batches, written
from tidemill.llm.groups import join_unique

KINDS = ("placeholder", "filler", "error_page", "script_notice")

SHOWN = re.compile(r"```.*?```|~~~.*?~~~|`[^`\n]+`|“[^“”]*”|„[^“”„]*[“”]|\$[^$\n]{1,60}\$(?![{\w])|\"[^\"\n]+\"", re.S)
IDENT = r"[A-Za-z][A-Za-z_]{2,24}"
SURE_SLOT = re.compile(
    r"\{\{\s*(%(i)s)\s*\}\}|\$\{\s*(%(i)s)\s*\}|<%%=?\s*(%(i)s)\s*%%>|\{%%\s*\w+\s+(%(i)s)\s*%%\}|\[\[\s*(%(i)s)\s*\]\]|@@\s*(%(i)s)\s*@@|_{3,}\s*\(\s*(%(i)s)\s*\)"
    r"|\[\s*(?:your|votre|ihr|ihre|su|tu|il tuo|la tua)\s+(%(i)s)\s*\]|\[\s*insert\s+(%(i)s)(?:\s+here)?\s*\]|\[\s*hier\s+(%(i)s)\s+(?:einfügen|eintragen)\s*\]|\(\s*insert\s+(%(i)s)\s*(?:here)?\)|\[\s*(%(i)s)\s+(?:goes|here|comes)\s+here\s*\]|\[\s*(?:insérer|insertar|inserire|einfügen)\s+(%(i)s)[^\]]{0,12}\]" % {"i": IDENT},
    re.I,
)
DOUBT_SLOT = re.compile(r"(?<![\w%%])%%(%(i)s)%%(?!\w)|(?<![\w#])#(%(i)s)#(?!\w)|«(%(i)s)»|(?<![\w$\\^}{])\{(%(i)s)\}(?!\})|<(%(i)s)>|(?<!\w)__(%(i)s)__(?!\w)|\[(%(i)s)\]" % {"i": IDENT})

# The words of the usual dummy text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
SCRIPT = r"(?:java ?script|js|scripts?|scripting|client-?side scripts?|cookies?(?: and (?:java)?scripts?)?)"
RULES = [
    ("filler", re.compile(r"^\W*(?:todo|tbd|tbc|fixme|tk)\b\s*(?:[:–—-]|$)|\b(?:your (?:content|text|copy) (?:goes|comes) here|this is (?:sample|dummy|placeholder|filler) text|(?:dummy|sample|placeholder|filler) text (?:for|only)|replace this (?:paragraph|text|copy|section) with|(?:body copy|text|content|copy) will appear here|write (?:a|an|your) (?:short |brief )?\w+ in this space)\b|^\W*(?:content|text|copy|section|paragraph|article|chapter|body|details|description|summary|introduction)\s+(?:coming soon|to come|to follow|pending|to be (?:added|written|supplied|provided|announced))\W*$|^\W*coming soon\b.{0,40}$|^\W*(?:\w+ ){0,3}(?:text|content|copy|section|article|chapter|paragraph|body) (?:is |still )*to be (?:written|added|supplied|provided|filled in|announced)\b|\bstill to be (?:written|added|supplied|filled in|announced)\W*$|^texte (?:provisoire|à venir|de remplissage)|à (?:remplacer|compléter) (?:plus tard|ici)?\W*$|^(?:hier (?:steht|folgt)|blindtext|platzhaltertext|platzhalter)\b|\bfolgt (?:in kürze|später|noch)\W*$|^(?:texto|contenido) (?:de relleno|provisional|de ejemplo|pendiente)|^(?:testo|contenuto) (?:segnaposto|provvisorio|di prova)", re.I)),
    ("error_page", re.compile(
        r"^\W*(?:(?:http |http/\d\.\d )?(?:error|status|code|fehler|fehlercode|erreur|código)\W{0,3})?#?[45]\d\d\W{0,4}(?:$|(?:not found|forbidden|unauthori[sz]ed|bad (?:request|gateway)|internal server error|service (?:temporarily )?unavailable|gateway time-?out|too many requests|gone|request time-?out|permission denied|access denied)\b)"
        r"|^\W*(?:not found|page not found|forbidden|access denied|permission denied|bad gateway|gateway time-?out|internal server error|interner serverfehler|service (?:temporarily )?unavailable|too many requests|upstream (?:timed out|timeout)|connection (?:timed out|refused|reset)|request time(?:d out|-?out)|server error|an? (?:unexpected |internal )?error (?:has )?occurred)\W*$"
        r"|^traceback \(most recent call last\)|^\w*(?:error|exception)(?::| at ).{0,80}$|^\s*file \"[^\"]+\", line \d+"
        r"|^\W*(?:your|the) session (?:has |is )?(?:expired|timed out|ended)\b|^\W*you (?:have been|were|are) (?:signed|logged) out\b|^\W*you (?:do not|don['’]t) have (?:permission|access)\b|^\W*(?:fatal error|parse error|warning|notice|deprecated): .{3,120} (?:on line|at line) \d+|^\W*your (?:role|account|group|plan) (?:may not|can ?not|can['’]t|does not|doesn['’]t|is not allowed to) |^\W*(?:please )?(?:sign|log) in (?:again )?to (?:see|view|keep|continue|read)\b"
        r"|^\W*(?:slow down and try again|retry (?:after|in)|try again (?:in|after))\b.{0,24}(?:second|minute|hour)|^\W*(?:this (?:site|page|service)|the (?:site|service|server)|we) (?:is|are) (?:currently |temporarily )?(?:down for|under|undergoing|in) (?:scheduled )?maintenance|^\W*we are (?:updating|upgrading) our (?:systems?|servers?)"
        r"|^\W*(?:the|this|that) (?:\w+ )?(?:page|document|resource|file|article|content|item|entry|url|link|address|story|record|post)(?: (?:you|that you|which you) .{2,40}?)? (?:could not be (?:found|located|loaded|opened)|does not exist|doesn['’]t exist|cannot be found|can['’]t be found|was not found|has been (?:removed|deleted|moved)|is (?:no longer|not) (?:available|here)|is gone|no longer exists|was (?:removed|deleted|moved))(?: (?:on|from|at|in) (?:this|the|our) \w+| any ?more| right now| at (?:this|the) (?:time|moment)| permanently)?\W*$"
        r"|^\W*(?:hmm|oops|sorry|whoops|uh-?oh)?\W*(?:we|i) (?:could(?: not|n['’]t)|can(?:not|['’]t)|did(?: not|n['’]t)) (?:find|locate|load) (?:that|this|the) \w+\W*$|^\W*there is nothing (?:at this|here)|^\W*(?:sorry\W+)?(?:no such|missing) \w+\W*$|^\W*the (?:back-?end|server|upstream|gateway|database) (?:did not|didn['’]t|failed to|is not) respon"
        r"|^\W*(?:seite|dokument|inhalt|datei) (?:wurde )?nicht gefunden|^\W*die (?:angeforderte|gesuchte|gewünschte) \w+ .{0,40}(?:nicht|entfernt|gelöscht)|^\W*der (?:angeforderte|gesuchte) \w+ .{0,40}(?:nicht|entfernt|gelöscht)|^\W*zugriff verweigert|^\W*ihre sitzung ist abgelaufen"
        r"|^\W*(?:page|document|contenu|fichier) (?:introuvable|non trouvée?|inexistante?)|^\W*erreur (?:interne|\d{3})|^\W*l[ea] (?:contenu|page|document|ressource) (?:demandée?|recherchée?) .{0,40}(?:plus|pas|introuvable)|^\W*accès (?:refusé|interdit)|^\W*votre session a expiré"
        r"|^\W*(?:página|documento|archivo|contenido) no (?:encontrad[ao]|disponible)|^\W*error (?:interno|\d{3})\b|^\W*(?:el|la) (?:contenido|página|documento|recurso) (?:solicitad[ao]|buscad[ao]) .{0,40}no|^\W*acceso denegado|^\W*su sesión ha (?:caducado|expirado)|^\W*pagina non trovata|^\W*errore (?:interno|del server|\d{3})", re.I)),
    ("script_notice", re.compile(
        rf"<noscript|^\W*checking your browser\b|^\W*(?:please |kindly |you (?:must|need to|have to|should) |(?:in order )?to (?:continue|view|see|read)[^.]{{0,30}},? ?(?:please )?)?(?:enable|activate|turn on|switch on|allow|unblock) {SCRIPT}\b|^\W*you (?:must|need to|have to|should) (?:\w+ )?(?:enable|activate|turn on|switch on|allow) (?:\w+ )?{SCRIPT}|^\W*(?:it (?:looks|seems) like |it appears that )?your browser (?:has|does not support|doesn['’]t support|blocks|is blocking|must) [^.]{{0,24}}\b{SCRIPT}\b|^\W*{SCRIPT} (?:is|are|must be|has been|have been|needs to be) (?:required|needed|disabled|blocked|turned off|switched off|off|allowed|enabled|activated)\b|^\W*(?:this|the|our) (?:\w+ )?\w+ (?:requires|needs|relies on|depends on|works only with|only works with|(?:will not|won['’]t|does not|doesn['’]t|cannot|can['’]t) (?:work|run|load|start|open) without) (?:\w+ )?{SCRIPT}\W*(?:$|to (?:work|run|load|function|continue|view|see))"
        r"|^\W*(?:bitte )?(?:aktivieren|erlauben) sie (?:bitte )?(?:javascript|cookies|skripte)|^\W*(?:javascript|skripte|cookies) (?:ist|sind) (?:aus|deaktiviert|blockiert|erforderlich|abge)|^\W*(?:merci d['’]|veuillez |vous devez )(?:activer|autoriser) (?:javascript|les cookies|les scripts)|^\W*javascript est (?:désactivé|requis|nécessaire)|^\W*(?:es necesario|debe|por favor,?) (?:habilitar|activar|habilite|active) (?:javascript|las cookies)|^\W*(?:active|habilite) (?:javascript|las cookies) en|^\W*javascript (?:está|esta) (?:desactivado|deshabilitado)|^\W*(?:attiva|abilita|attivare|abilitare) (?:javascript|i cookie)|^\W*(?:включите|разрешите) javascript|请启用 ?javascript", re.I)),
]
WEAK = [
    ("error_page", re.compile(r"\b(?:not found|unavailable|timed out|maintenance|expired|denied|try again|log in once more|come back (?:in|after|later|soon)|check back)\b", re.I)),
    ("script_notice", re.compile(rf"\b(?:browser|{SCRIPT})\b.*\b(?:enable|disabled|allow|allowed|required|blocked|seconds)\b", re.I)),
    ("filler", re.compile(r"\b(?:placeholder|sample|dummy|filler) (?:text|copy)\b|\bto be (?:added|written)\b|\bpending\b", re.I)),
]
# Words of each kind; of a recurring message, most must be such words or function words, and one of the first set must be there.
WORDS_OF = {
    "error_page": (
        frozenset("error errors found unavailable denied forbidden expired timeout timed invalid offline broken maintenance refused failed failure unreachable crashed missing unauthorized".split()),
        frozenset("page server site service request requested url link address session login permission access status code connection loaded load load exist exists retry again later moment back reload refresh return home sorry oops wrong went something problem occurred happened unexpected internal temporarily currently removed moved deleted unable cannot could not resource document content response website support administrator contact n".split()),
    ),
    "script_notice": (
        frozenset("javascript script scripts scripting js cookies cookie browser captcha robot".split()),
        frozenset("enable enabled disabled disable required requires require turn turned on off allow allowed support supported supports reload refresh settings site page website app application view see continue work works properly please must need checking verify verifying human security before proceed blocked blocker".split()),
    ),
    "filler": (
        frozenset("placeholder dummy filler lorem todo tbd".split()),
        frozenset("text content copy sample here soon added add coming come goes insert replace default section description paragraph title heading image caption pending written write final later draft example".split()),
    ),
}
LINKS = frozenset("the a an and or to of in on at for is are was be been has have had you your we our this that it if by with as not no do does did us i can will may there from when while please".split())
# Words of which a message must have one to be matched by any of the rules above: the rules are not tried on others.
CUES = tuple(
    "todo|tbd|tbc|fixme|text|content|copy|paragraph|soon|pending|found|denied|forbidden|error|fehler|erreur|unavailable|session|signed|logged|sign in|log in|again|retry|maintenance|updating|upgrading|exist|removed|deleted|moved|find|locate|load|nothing|no such|missing|respon|traceback|exception|file \"|gefunden|verweigert|abgelaufen|nicht|introuvable|demand|refus|expir|encontrad|disponible|solicitad|denegad|trovata|browser|javascript|script|cookie|js|requests|timed|timeout|time-out|gateway|platzhalter|blindtext|folgt|hier|steht|provisoire|relleno|segnaposto|space|ipsum|lorem|permission|available|server|to be |to come|your role|your account|on line|to follow|seite|página|pagina|accès|acceso|zugriff|sitzung|sesión|unauthori|bad request|upstream|connection|offline|down for|werden|remplac|sustituir|ersetz|ejemplo|prueba|adipiscing|eiusmod|incididunt|fugiat|veniam|aliquip|laboris|nostrud|commodo|consequat|cillum|pariatur|irure|400|401|403|404|408|410|429|500|502|503|504".split("|")
)
try:
    import ahocorasick

    _automaton = ahocorasick.Automaton()
    for _cue in CUES:
        _automaton.add_word(_cue, 1)
    _automaton.make_automaton()

    def cued(low: str) -> list[int]:
        """Where the cues of a text in lower case end."""
        return [at for at, _ in _automaton.iter(low)]
except ImportError:  # the same with a regular expression
    _pattern = re.compile("(?=(" + "|".join(map(re.escape, sorted(CUES))) + "))")

    def cued(low: str) -> list[int]:
        return sorted(m.end(1) - 1 for m in _pattern.finditer(low))


SPLIT = re.compile(r"[\r\n]+|(?<=[.!?。])\s+(?=\S)|(?<=[.!?])(?=<)")
MAIL = re.compile(r"\b\S+@\S+\.\w+\b")
VARIABLE = re.compile(
    r"(?P<url>(?:https?://|www\.)\S+|\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<date>\b\d{4}-\d\d?-\d\d?(?:[t ]\d\d?:\d\d(?::\d\d)?z?)?\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d\d?:\d\d(?::\d\d)?\b)"
    r"|(?P<id>\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\b[0-9a-f]{8}-[0-9a-f-]{20,}\b)|(?P<n>\d+(?:[.,]\d+)*)",
    re.I,
)
DIGITS = re.compile(r"\d|www\.|https?:", re.I)
HTML_TAGS = frozenset("html head body title div span table tbody thead tfoot section article header footer nav aside main form input button select option label textarea img svg path video audio source iframe script noscript style link meta base pre code kbd samp var blockquote cite abbr time mark small strong sub sup ins del dfn bdo ruby details summary figure figcaption picture canvas object param embed map area col colgroup caption legend fieldset optgroup progress meter dialog template slot font center strike big frame frameset applet endoftext".split())
CLOSE = "</"


def mask(message: str) -> str:
    """A message in lower case, without what differs from one delivery to the next."""
    if "@" in message:
        message = MAIL.sub("<url>", message)
    if DIGITS.search(message):
        message = VARIABLE.sub(lambda m: f"<{m.lastgroup}>", message)
    return " ".join(message.lower().split())


def repeated(tokens: list[str]) -> bool:
    """Nothing but one word again and again, as typed to fill space."""
    return len(tokens) >= 3 and len(set(tokens)) == 1 and tokens[0].isalpha() and len(tokens[0]) > 1


def lorem(tokens: list[str]) -> bool:
    return len(tokens) >= 4 and sum(t in LOREM for t in tokens) >= 0.7 * len(tokens)


def classify(message: str) -> tuple[str | None, bool]:
    """The kind of a message by the phrase rules, and whether only a weaker rule gave it."""
    tokens = WORD.findall(message.lower())
    if message.rstrip().endswith("?") or re.match(r"^(?:q|a|question|answer)\s*[:.]", message, re.I):
        return None, False
    if repeated(tokens) or lorem(tokens):
        return "filler", False
    for kind, rule in RULES:
        if rule.search(message):
            return kind, False
    if len(tokens) <= 10:
        for kind, rule in WEAK:
            if rule.search(message):
                return kind, True
    return None, False


def recurring_kind(message: str) -> str | None:
    """The kind of a message that recurs widely, by its words alone: at least three of one kind, and few of none."""
    tokens = WORD.findall(message)
    if not 3 <= len(tokens) <= 16:
        return None
    content = [t for t in tokens if t not in LINKS]
    for kind, (sure, more) in WORDS_OF.items():
        hits = sum(t in sure or t in more for t in content)
        if hits >= 3 and hits >= 0.75 * len(content) and any(t in sure for t in content):
            return kind
    return None


def messages(text: str | None) -> tuple[list[tuple[str, str | None, bool]], list[str], list[str]]:
    """All messages (masked text, kind or none, whether by a weak rule), names of sure slots, names of doubtful slots."""
    if not text or not text.strip():
        return [], [], []
    text = clean(text)
    if "&" in text:
        text = html.unescape(text)
    bare = SHOWN.sub(" ¤ ", text)
    sure, doubt = [], []
    if any(c in bare for c in "{<[(@_$"):
        sure = [next(filter(None, g)).lower() for g in SURE_SLOT.findall(bare)]
    if any(c in bare for c in "%#«{<_["):
        for m in DOUBT_SLOT.finditer(SURE_SLOT.sub(" ", bare)):
            name = m.group(m.lastindex)
            low = name.lower()
            if m.group(0)[0] == "<" and (low in HTML_TAGS and (low not in ("title", "summary") or f"{CLOSE}{name}" in text) or f"{CLOSE}{name}" in text):
                continue
            doubt.append(("[" if m.group(0)[0] == "[" else "") + low)
    out, hits, start, k = [], cued(bare.lower()), 0, 0
    ends = [m.span() for m in SPLIT.finditer(bare)] + [(len(bare), len(bare))]
    for stop, after in ends:
        while k < len(hits) and hits[k] < start:
            k += 1
        message = bare[start:stop]
        has_cue = k < len(hits) and hits[k] < stop
        start = after
        message = message.strip(" \t#*>|-–—•")
        if len(message) < 3 or "¤" in message:
            continue
        if not has_cue:
            ws = message.split(None, 12)
            has_cue = len(ws) >= 3 and len(set(map(str.lower, ws[:-1]))) <= 2  # one word again and again
        out.append((mask(message), *(classify(message) if has_cue else (None, False))))
    return out, sure, doubt


def scanned(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One row per finding: a classified message, or the name of a slot."""

    def fn(ids: list, texts: list, sources: list) -> dict[str, list]:
        out: dict[str, list] = {"doc_key": [], "source": [], "what": [], "value": [], "weak": []}
        for i, t, s in zip(ids, texts, sources):
            found, sure, doubt = messages(t)
            rows = {(k, m, w) for m, k, w in found} | {("slot", n, False) for n in sure} | {("slot?", n, True) for n in doubt}
            for what, value, weak in rows:
                out["doc_key"].append(i), out["source"].append(s), out["what"].append(what), out["value"].append(value), out["weak"].append(weak)
        return out

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(text).isNotNull()).select(key, text, F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(source).cast("string"), F.lit("")), "[-_ ]+", "_"))).alias("_source"))
    return map_batches(rows, [key, text, "_source"], fn, f"doc_key {kind}, source string, what string, value string, weak boolean")


def few_or_joined(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    return rows.join(F.broadcast(few) if few.count() <= MOST_BROADCAST else few, key)


def residue(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", least_documents: int = 3, least_sources: int = 2) -> DataFrame:
    """(doc, kind, route): what should be excluded, with how widely the document's most widespread message of the kind recurs."""
    rows = written(scanned(df, key, text, source).withColumn("hash", F.unhex(F.md5(F.concat_ws(" ", F.when(F.col("what").startswith("slot"), "slot").otherwise(F.coalesce("what", F.lit("?"))), F.regexp_replace("value", r"^\[", ""))))))

    def counted(some: DataFrame) -> DataFrame:
        """Exact hashes over all documents and sources; the counts are aggregated before they are shuffled."""
        by = some.groupBy("hash", "source").agg(F.count_if(~F.col("weak")).alias("n_sure"), F.count("*").alias("n"))
        return by.groupBy("hash").agg(F.sum("n_sure").alias("n_sure"), F.sum("n").alias("n_documents"), F.count("*").alias("n_sources"))

    known, others = rows.where("what is not null"), rows.where("what is null")
    groups = cut(counted(known))
    kept = join_unique(known, groups, "hash", most=groups.agg(F.max("n_documents")).collect()[0][0] or 0)  # some slots and messages are very widespread
    recurs = (F.col("n_documents") >= least_documents) & (F.col("n_sources") >= least_sources)
    slot = F.col("what").startswith("slot")
    kind = F.when((F.col("what") == "slot") | (F.col("what") == "slot?") & (F.col("n_sure") > 0), "placeholder").when(~slot & (~F.col("weak") | recurs), F.col("what"))
    kept = kept.select("doc_key", kind.alias("kind"), F.when(slot, "slot").when(F.col("weak"), "recurring").otherwise("phrase").alias("route"), "n_documents", "n_sources").where("kind is not null")
    # All other messages that recur widely, by their words.
    wide = cut(counted(others).where(recurs))
    wide = few_or_joined(others.select("hash", "value"), wide, "hash").groupBy("hash", "n_documents", "n_sources").agg(F.min("value").alias("value"))
    kinds = cut(map_batches(wide, ["hash", "n_documents", "n_sources", "value"], _classified, "hash binary, n_documents bigint, n_sources bigint, kind string").where("kind is not null"))
    more = few_or_joined(others.select("doc_key", "hash"), kinds, "hash").select("doc_key", "kind", F.lit("recurring").alias("route"), "n_documents", "n_sources")
    return kept.unionByName(more).groupBy(F.col("doc_key").alias(key), "kind").agg(F.min("route").alias("route"), F.max("n_documents").alias("n_documents"), F.max("n_sources").alias("n_sources"))


def _classified(hashes: list, documents: list, sources: list, values: list) -> dict[str, list]:
    return {"hash": hashes, "n_documents": documents, "n_sources": sources, "kind": [recurring_kind(v) for v in values]}
