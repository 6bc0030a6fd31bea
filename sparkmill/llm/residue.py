"""Template residue, filler, error pages and script notices (problem 10).

A text is reduced to what a person would have written: code, quotes, navigation
and page frames off. What is left is read line by line. A document is trusted residue if every line after at most a
heading is a notice, an error, filler or an unfilled template, or if its prose has unfilled places. The labels then spread: bodies
of documents that are near-duplicates (five-word shingles of similarity 0.8, found without loss over the first
shingles of each body in one order) form connected components, and a component takes the label of its trusted members.

Bodies are compared once each however many documents share them, so hot groups of copies cost nothing.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.session import cut, spread, table

#: Words in a shingle; the least similarity of near-duplicates as a fraction, so that it is compared in whole numbers.
SHINGLE, SIMILAR, OF = 5, 4, 5

_FENCE = re.compile(r"```.*?(?:```|\Z)|<pre>.*?(?:</pre>|\Z)|<code>.*?(?:</code>|\Z)", re.S | re.I)
_INLINE = re.compile(r"`[^`\n]*`")
_CODE_LINE = re.compile(r"^(?:    |\t|\$ |\s*\|.*\|\s*$|\s*&?gt;|>|\s*File \"|Traceback )")
_SETTING = re.compile(r"^\$ |^[a-z_]+: ?\$\{\w+\}$")
_FRAME = re.compile(r"</?(?:div|p|span|br|section|article|main)\b[^>]*>", re.I)
_TOKENS = re.compile(r"<\|[a-z]+\|>")
#: Words of page navigation.
NAVIGATION = frozenset("search tags users terms cookies about contact home acasa cos login logout cont cautare register faq help privacy menu skip sign up in".split())


_FOREIGN = re.compile(r"[^\x00-\x7f]+")


def fold(s: str) -> str:
    if s.isascii():
        return s.lower()
    return _FOREIGN.sub(lambda m: "".join(c for c in m[0] if not unicodedata.combining(c)), unicodedata.normalize("NFKD", s.lower()))


def _plain_letters(s: str) -> str:
    """Without letters of foreign scripts, symbols and invisible characters that got into a text."""
    if s.isascii():
        return s
    return _FOREIGN.sub(lambda m: "".join(c for c in m[0] if ord(c) < 0x250 or c in "‘’“”„–—…©" or 0x300 <= ord(c) < 0x370), s)


def _navigation(line: str) -> bool:
    for m in re.finditer(r"\w+", fold(line)):
        if m[0] not in NAVIGATION:
            return False
    return True


def lines_of(text: str) -> list[str]:
    """The lines of a text that are neither code, quotes, navigation nor frame, with single spaces."""
    s = (html.unescape(text) if "&" in text else text).replace("\r", "")
    s = _FENCE.sub("\n", _TOKENS.sub("", s))
    s = _FRAME.sub(" ", s)
    out = []
    for line in s.split("\n"):
        if _CODE_LINE.match(line):
            continue
        x = re.sub(r"[\s\xa0]+", " ", _plain_letters(line)).strip()
        if not x or x[0] == "©" or _SETTING.match(x) or _navigation(x):
            continue
        out += re.split(r"(?<=[^\W\d_]\?) (?=[^\W\d_])", x, maxsplit=1) if not out else [x]  # a heading with the text behind it
    return out


#: Beginnings of notices and errors in the corpus's languages, folded.
_NOTICES = re.compile(
    r"""^(?:<noscript>|
    (?:please\ )?(?:enable|turn\ on|activate|switch\ on)\ (?:javascript|scripts)| you\ need\ to\ enable\ javascript| javascript\ (?:is|must\ be|has\ to\ be)\ |
    we\ are\ sorry,?\ but\ this\ | this\ (?:forum|site|page|app|website)\ (?:works\ best\ with|needs|requires)\ (?:javascript|scripts|cookies)|
    your\ browser\ (?:has\ scripts|does\ not|doesn't|is\ not)| scripts\ are\ (?:blocked|off|disabled|required)|
    activati\ (?:javascript|scripturile)| va\ rugam\ sa\ (?:permiteti|activati)| bitte\ aktivieren\ sie\ (?:javascript|cookies)| veuillez\ activer\ javascript|
    (?:erreur|eroare|error|fehler|http)[\s:]*[1-5]\d\d\b| [45]\d\d[\s:–-]+(?:not\ found|forbidden|bad\ gateway|bad\ request|unauthorized|internal\ server|gateway\ time|service\ (?:temporarily\ )?unavailable|too\ many|gone|method)|
    error\ establishing\ a\ database| (?:oops|hmm|sorry|whoops|uh-oh)[!.,:]?\ the\ page\ you| the\ page\ you\ (?:are\ looking|requested|tried|were)| the\ server\ at\ \S+\ (?:is|encountered|took|could)|
    seite\ nicht\ gefunden\ [–-]| page\ (?:introuvable|not\ found)| pagina\ (?:cautata\ )?nu\ (?:a\ fost\ gasita|exista)| la\ page\ demandee\ est|
    access\ denied\.| you\ don't\ have\ permission\ to| too\ many\ requests\.| verify\ that\ you\ are\ human| checking\ your\ browser\ before| your\ session\ has\ expired| this\ content\ is\ unavailable| something\ went\ wrong\ on\ our|
    this\ domain\ \S+\ is\ parked| buy\ it\ now\ from\ its\ owner| (?:warning|notice|fatal\ error|parse\ error):\ .*(?:on\ line\ \d|memory\ size|expects\ parameter)|
    \{"(?:status|error|code|message)":| <html><head><title>| [a-z][a-z-]*/\d[\d.]+$| ref(?:erence)?[\s:#]+[0-9a-f.]+$| ray\ (?:id\ )?[0-9a-f]+$| loading(?:…|\.\.\.)?$| reload\ the\ page| \(client\ [0-9a-f]+\)
    )""",
    re.X,
)
#: Beginnings of filler, folded.
_FILLERS = re.compile(
    r"""^(?:lorem\ ipsum\b| texte\ de\ remplissage| votre\ texte\ ici| introduceti\ textul| acesta\ este\ un\ text\ de\ umplutura| hier\ steht\ ein\ blindtext| platzhalter\ fur|
    your\ text\ here| sample\ (?:content|text)\ goes\ here| write\ your\ (?:answer|text|question)\ here| type\ something,?\ | content\ (?:coming\ soon|goes\ here)| continutul\ va\ fi\ adaugat| coming\ soon| answer\ to\ be\ added| (?:this\ is\ )?a?\s?placeholder\ (?:post|text|answer)| this\ is\ a\ (?:placeholder|test\ post)|
    (?:-+\ *)?(?:ignore\ this\ post|testing,\ please\ ignore|dummy\ (?:answer|post|text)(?:\ \d+)?)\W*$| (?:-{3,}\ *)?test(?:\ \d+)?$| -{3,}$| \.{3,}$| (?:tbd|todo|tba|n/a|xxx)(?:\ (?:tbd|todo|tba|n/a|xxx))+|
    insert\ (?:text|content)\ here| text\ (?:here|goes\ here)$| undefined$| null$| \[object\ object\]$
    )""",
    re.X,
)
_LOREM = frozenset("lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua".split())
#: Words that hardly any prose of these languages goes without.
_COMMON = frozenset(
    "the a an is are was and or of to in on it that this with for not you i my by as at be have has from when if can how what why do does"
    " de la le les un une et est pas pour dans que qui ne sur avec du des en il ce si sa se cu nu este o pe din ca mai sunt fara cum care"
    " der die das und ist nicht ich ein eine mit zu auf den von wie warum was dem bei kann".split()
)
_LATIN = frozenset("do in et ut sit a de".split())
_ROW = re.compile(r"^(?:[asdfghjkl]{10,}|[qwertyuiop]{10,}|[zxcvbnm]{10,})$")

_FIELD = r"[A-Za-z_][\w .'-]{0,30}?"
_HTML = frozenset("a b i p u s br hr li ul ol td tr th em tt h1 h2 h3 h4 h5 h6 pre div img code html head body span table tbody thead strong small noscript script style blockquote kbd sup sub del ins dl dt dd meta".split())
_PLACE = re.compile(
    rf"\{{\{{\{{?\s*{_FIELD}\s*\}}\}}\}}?|\{{!{_FIELD}\}}|[$#]\{{{_FIELD}\}}|%%{_FIELD}%%|@@{_FIELD}@@|\*\|{_FIELD}\|\*|<%=?\s*{_FIELD}\s*%>|\[\[{_FIELD}\]\]|<<{_FIELD}>>|(?<!\w)__[A-Za-z][\w .]{{1,30}}?__(?!\w)"
    rf"|(?<![\w:]):[A-Za-z_][A-Za-z_.]{{2,24}}:(?![\w:])|(?<![\w$])\$[A-Za-z_][A-Za-z_.]{{2,24}}\$(?![\w$])|\[(?:INSERT |YOUR )?[A-Za-z][A-Za-z_. ]{{2,30}}\](?!\]|\s*\()|(?<![\w$#{{])\{{[A-Za-z_][A-Za-z_.]{{2,24}}\}}(?!\}})"
    rf"|\[object object\]|(?<!\w)NaN (?:days|hours|minutes) ago|\{{%-? ?(?:block|endblock|include|extends|if|for)\b",
    re.I,
)
_ANGLE = re.compile(r"<([A-Za-z][\w.]*(?: [\w ]+)?)>")
_FORMAT = re.compile(r"%[sd]\b", re.I)
#: Words of someone who writes about such places.
_ABOUT = re.compile(
    r"\b(?:templates?|braces?|placeholders?|literally|format string|regex|escape|render(?:s|ed)?|angle brackets|export|syntax|interpolat\w*|f-string|printf|merge tags?|replaces|variables?|catch|sablon\w*|acolade|platzhaltern?|gabarit)\b|\bleaves .* alone\b",
    re.I,
)


_SIGNS = re.compile(r"[{%@*<\[_:$]|\bNaN ", re.I)


def unfilled(line: str) -> bool:
    """Whether a line of prose has unfilled places that it doesn't write about."""
    if not _SIGNS.search(line):
        return False
    s = _INLINE.sub(" ", line)
    places = len(_PLACE.findall(s)) + sum(1 for m in _ANGLE.finditer(s) if m[1].replace(" ", "").lower() not in _HTML)
    formats = 0 if re.search(r"\(\s*f?[\"']|[\"']\s*%", s) else len(_FORMAT.findall(s))
    if not places and formats < 2:
        return False
    return not _ABOUT.search(line)


def filler(line: str) -> bool:
    f = fold(line)
    words = re.findall(r"[^\W\d_]+", f)
    if _FILLERS.match(f):
        return True
    if not words:
        return False
    if len(words) >= 4 and len(set(words)) == 1:
        return True
    if all(_ROW.match(w) for w in words):
        return True
    lorem = sum(w in _LOREM for w in words)
    plain = sum(w in _COMMON and w not in _LATIN for w in words)
    return len(words) >= 4 and (lorem >= 0.4 * len(words) or (lorem > 0 and plain <= 0.12 * len(words) and not re.search(r"[`:=/\"]|\?$", line)))


def notice(line: str) -> bool:
    return bool(_NOTICES.match(fold(line)))


def _nonce(line: str) -> bool:
    """Words, but none that prose goes without: says nothing by itself, only beside filler."""
    words = re.findall(r"[^\W\d_]+", fold(line))
    return len(words) >= 3 and not any(w in _COMMON for w in words) and not re.search(r"[?:`=/]", line)


def trusted(text: str | None) -> tuple[bool, bool, str]:
    """Whether a text is residue as a whole, whether its prose has unfilled places, and its whole body for comparison, code taken off ("" where it has no words)."""
    if not text or not text.strip():
        return False, False, ""
    lines = lines_of(text)
    if not lines:
        return False, False, ""
    whole = _whole(lines)
    open_ = any(unfilled(x) for x in lines) and not (any(_ABOUT.search(x) for x in lines) and _asks(lines))
    head = len(lines) > 1 and not (notice(lines[0]) or filler(lines[0]) or unfilled(lines[0]))
    body = " ".join(lines[1:] if head and whole else lines)
    return whole, open_, " ".join(re.findall(r"[^\W\d_]+", fold(_PLACE.sub(" placeholder ", body))))


def _whole(lines: list[str]) -> bool:
    """Whether all lines are notices, filler, unfilled or no words, after at most a heading, and one of them is a notice or filler. Beside such a line, one of unknown words is none either."""
    bad = False
    for i, x in enumerate(lines):
        if notice(x) or filler(x):
            bad = True
        elif i and not (unfilled(x) or not re.search(r"\w", x) or _nonce(x)):
            return False
    return bad


def _asks(lines: list[str]) -> bool:
    """Someone who asks or explains: a question, or an instruction with a tool."""
    return any("?" in x for x in lines) or len(lines) <= 3


def shingles(body: str) -> set[str]:
    w = body.split()
    return {" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}


def read_documents(docs: DataFrame) -> DataFrame:
    """doc_id, whole, open, body."""
    schema = "doc_id bigint, whole boolean, open boolean, body string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = [(i, *trusted(t if isinstance(t, str) else None)) for i, t in zip(d["doc_id"], d["text"])]
            yield pd.DataFrame(rows, columns=["doc_id", "whole", "open", "body"], dtype="object").astype({"doc_id": "int64", "whole": "bool", "open": "bool"})

    return spread(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), "doc_id").mapInPandas(run, schema)


def shingle_sets(bodies: DataFrame, key: str = "body") -> DataFrame:
    """key, n, set: the different shingles of each body as 64-bit hashes in order, and their number."""
    sets = bodies.select(F.col(key).alias("key"), F.split("body", " ").alias("ws"))
    last = F.greatest(F.size("ws") - SHINGLE + 1, F.lit(1))
    sets = sets.select("key", F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice("ws", i, SHINGLE), " "))))).alias("set"))
    return sets.select("key", F.size("set").alias("n"), "set")


def _beginnings(sets: DataFrame) -> DataFrame:
    """key, n, at, s: of each body's n shingles the first n - ceil(0.8 n) + 1 with their places from 0."""
    first = F.floor(F.col("n") * (OF - SIMILAR) / OF).cast("int") + 1
    return sets.select("key", "n", F.posexplode(F.slice("set", F.lit(1), first)).alias("at", "s"))


def near_bodies(from_: DataFrame, to: DataFrame) -> DataFrame:
    """a, b: all pairs of a body of one table of shingle_sets and a different one of the other with a Jaccard similarity of at least SIMILAR / OF.

    With all shingles in one order (that of their hashes), two such bodies of m and n shingles share one of their first m - ceil(0.8 m) + 1 and n - ceil(0.8 n) + 1, so
    no pair is missed; a fifth of the shingles is moved, and what can't reach the similarity from where the two meet is dropped there. Candidates are verified exactly.
    """
    x, y = _beginnings(from_).alias("x"), _beginnings(to).alias("y")
    # at most this many are shared: as many before as the one that has fewer, and as many from here on
    most = F.least("x.at", "y.at") + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    can = (OF + SIMILAR) * most >= SIMILAR * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.key") != F.col("y.key")) & can).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    pairs = pairs.join(from_.select(F.col("key").alias("a"), F.col("set").alias("p")), "a").join(to.select(F.col("key").alias("b"), F.col("set").alias("q")), "b")
    both = F.size(F.array_intersect("p", "q"))
    return pairs.where((OF + SIMILAR) * both >= SIMILAR * (F.size("p") + F.size("q"))).select("a", "b")


def spread_labels(bodies: DataFrame) -> DataFrame:
    """key of every body (key, whole, body; different bodies) in a connected component of near-duplicates that holds one with whole set.

    The components are walked from these: each step looks from the bodies that were reached last at those that were not reached yet, so bodies
    that are labelled already never meet each other, and components without a label are not built. Ends when a step reaches none.
    """
    sets = cut(shingle_sets(bodies, "key"))
    last = cut(bodies.where("whole").select("key"))
    reached = last
    while True:
        open_ = sets.join(reached, "key", "left_anti")
        found = cut(near_bodies(sets.join(last, "key", "left_semi"), open_).select(F.col("b").alias("key")).distinct())
        if not found.head(1):
            return reached
        last, reached = found, cut(reached.unionByName(found))


def residue(docs: DataFrame) -> DataFrame:
    """doc_id, reason of every document that is residue: "trusted", "unfilled" or "near" (in a component of near-duplicates with a trusted one).

    Bodies are known by 64-bit hashes, so components hold no texts. Empty, blank and null texts are none. Other columns are ignored; repeated ids give one row each reason.
    """
    read = cut(read_documents(docs).withColumn("key", F.when(F.col("body") != "", F.xxhash64("body"))))
    bodies = read.where("key IS NOT NULL").groupBy("key").agg(F.max("whole").alias("whole"), F.first("body").alias("body"))
    near = spread_labels(cut(bodies)).withColumn("near", F.lit(True))
    return read.join(near, "key", "left").select("doc_id", F.when(F.col("whole"), "trusted").when(F.col("open"), "unfilled").when(F.col("near"), "near").alias("reason")).where("reason IS NOT NULL")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is residue in place of content, or has unfilled places."""
    return residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()
