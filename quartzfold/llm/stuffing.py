"""Keyword-stuffed and link-list pages.

Every page's words, digits read as 0, are cut into phrases of five that run
across lines and markup; the phrases are exploded and it is counted over the
whole crawl on how many hosts each stands. That evidence is joined with list
density: a page is cut into pieces at line breaks and ends of sentences. Words of links
(with their labels), of tags and of product items (code, goods, price) are list
words as such. Any other piece is measured for list density: the share of
function words and how often its word pairs recur. Lists of members voting or
present, items of agendas and tables most of whose cells are numbers are set
aside. Short lines in a row are measured as one piece, and so are short
sentences in a row, which are a list only if their word pairs recur. A piece that
looks like a list without being decided by density is decided by replication: it
is stitched if most of its phrases without a function word stand on other hosts
too. A page is flagged
if more than half of its words are in lists.

Replication alone cannot decide: speeches, agendas and tables repeat phrases
across hosts at least as much as spam does. So phrases with a function word,
which stand among sentences, are no evidence for a page or piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzfold.session import materialize

# Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    "the of and a an to in for on with that this is are was were be been it its as at by from we i you he she they our your their has have had will would should not but or if so which who what when than there here all any because before after about into over under can could must may nobody let me my us do does did to "
    "der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war wird werden wurde hat haben hatte zu zum zur von vom mit auf in im an am für bei nach aus über unter wenn dass wie was wer wir ich sie er es man auch noch nur schon so als denn weil muss sich dazu daran "
    "le la les l un une des du de d et ou mais ne pas ce cette ces est sont était être a ont avait à au aux en dans sur pour par avec sans que qui quoi dont nous vous je il elle ils on se sa son ses leur plus si y c n qu j "
    "el los las un una unos y o pero es son era ser ha han había a al del de en con por para sin sobre que quien como nos se su sus lo le les yo más ni si esto este esta ante hay".split()
) - {"pas", "no", "a"}
#: A piece with fewer words is not measured.
LEAST_WORDS = 5
#: Words next to a link that are its label, if they are no sentence.
LABEL = 8
#: Lines without an end of sentence of at most so many words are joined.
SHORT = 8
#: Below this share of function words a piece is a list; below the second it may be one.
#: They are shares of the words of more than one letter and of elided articles.
FEW, SOME = 0.06, 0.34
#: From this share of recurring word pairs on a piece is a list, whatever its function words; from the second on it may be one.
OFTEN, SOMETIMES = 0.4, 0.12
#: Words of a phrase.
PHRASE = 5
#: Share of phrases without a function word from which on a piece in doubt is decided by them.
LISTLIKE = 0.2
#: Share of a page's words.
MOST = 0.5

PIECES = re.compile(r"(?<=[^\W\d][.!?])\s+|(?<=[)\]][.!?])\s+|(?<=\s[!?])\s+|\n+")
ANCHOR = re.compile(r"<a\b[^>]*>.*?</a\s*>", re.I | re.S)
LINK = re.compile(r"(?:https?://|www\.)\S+|(?<![\w@.])[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}/\S*", re.I)
MARKED = re.compile(r"\[[^\]\n]*\]\([^)\s]*\)")
TAG = re.compile(r"(?<!\w)#\w+")
#: A product item: a code, the goods and a price; after the word SKU the price may be missing.
GOODS = r"(?:[^\S\n]+[^\W\d_][\w'’-]*)"
PRICE = r"[^\S\n]+[$€£]?\d+[.,]\d{2}(?!\w)"
PRODUCT = re.compile(rf"(?<![\w-])(?:(?:SKU[^\S\n]+)?[^\W\d_]\w*-\d+{GOODS}{{1,6}}{PRICE}|SKU[^\S\n]+[\w-]*\d[\w-]*{GOODS}{{0,6}}(?:{PRICE}|(?=[^\S\n]*(?:[\n;|]|$))))")
#: Without a match no product item can be there.
CODE = re.compile(r"\w-\d|SKU")
WORD = re.compile(r"[^\W_]+")
COMPOUND = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
CELLS = re.compile(r"[|;:\t]")
DIGITS = re.compile(r"\d")
ELIDED = re.compile(r"(?<![\w-])[cdjlmnst](?=['’][^\W\d_])", re.I)
NUMERIC = re.compile(r"[\s\d.,/%+–-]*\d[\s\d.,/%+–-]*")


def _is_roll(piece: str) -> bool:
    """A roll of names: items parted by semicolons, nearly all of capitalised words only."""
    if piece.count(";") < 2:
        return False
    items = [i.split() for i in piece.split(";")]
    names = sum(1 for i in items if i and all(w[:1].isupper() for w in i[-2:]))
    return names >= 0.7 * len(items)


def _is_item(piece: str) -> bool:
    """An item of an agenda: numbered, with number/year in brackets at its end."""
    return re.match(r"\s*\d+[.)]\s.*\([^()]*\d+/\d+\)\s*\.?\s*$", piece, re.S) is not None


def _is_names(lines: list[str]) -> bool:
    """Names, one a line: nearly all lines are two or more capitalised words."""
    names = sum(1 for i in lines if len(i.split()) > 1 and all(w[:1].isupper() for w in i.split()))
    return names >= 0.7 * len(lines)


def _runs(pieces: list[str]) -> Iterator[tuple[str, list[str], list[str]]]:
    """Pieces in a row that are measured together: (kind, pieces, words).

    A run is of lines without an end of sentence ("lines"), or of sentences too
    short to be measured ("sentences"). Interjections and remarks in brackets,
    rows of tables and items of agendas stand alone ("table" if not measured).
    """
    run, held, before = [], [], ""
    for i, piece in enumerate(pieces):
        words = _words(piece)
        if not words:
            continue
        bare = piece.strip()
        last = bare[-1]
        if (bare[0].isdigit() and _is_item(piece)) or (DIGITS.search(piece) and _is_table(piece, words)) or ("|" in piece and _heads(pieces, i)):
            kind = "table"
        elif last in ")]" or bare[0] in "([–—-":
            kind = "piece"
        elif len(words) <= SHORT and last not in ".!?…:" and not _is_roll(piece):
            kind = "lines"
        else:
            kind = "sentences" if len(words) < LEAST_WORDS else "piece"
        if run and (kind != before or kind in ("table", "piece")):
            yield before, run, held
            run, held = [], []
        run.append(piece)
        held += words
        before = kind
    if run:
        yield before, run, held


def _is_table(piece: str, words: list[str]) -> bool:
    """A row of a table: most of its cells, or of its words, are numbers; without a digit it is none."""
    if sum([w.isdigit() for w in words]) > len(words) / 2:
        return True
    cells = [c for c in CELLS.split(re.sub(r"^\s*\d+[.)]\s", "", piece)) if c.strip()]
    return len(cells) > 1 and sum([NUMERIC.fullmatch(c) is not None for c in cells]) >= len(cells) / 2


def _heads(pieces: list[str], i: int) -> bool:
    """The head of a table: as many cells as the table's row below it."""
    bars = pieces[i].count("|")
    return bars > 0 and i + 1 < len(pieces) and pieces[i + 1].count("|") == bars and _is_table(pieces[i + 1], WORD.findall(pieces[i + 1]))


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


#: Odd multipliers by which the hashes of a phrase's words are added up, modulo 2^64.
PLACES = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(PHRASE)], np.uint64)
#: Hashes of words seen by this process, forgotten when there are too many.
SEEN: dict[str, int] = {}
MOST_SEEN = 500_000
#: The last bits of a hash tell function words and numbers.
FUNCTION, NUMBER = 1, 2


def _hash(word: str) -> int:
    h = xxhash.xxh3_64_intdigest(DIGITS.sub("0", word)) & ~3
    SEEN[word] = h = h | (FUNCTION if len(word) > 1 and word in FUNCTION_WORDS else 0) | (NUMBER if word.isdigit() else 0)
    return h


def _hashes(words: list[str]) -> np.ndarray:
    if len(SEEN) > MOST_SEEN:
        SEEN.clear()
    seen = SEEN
    return np.array([seen[w] if w in seen else _hash(w) for w in words], np.uint64)


def phrases(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all phrases of a row of words, in order, and which have no function word and not only numbers; digits count as 0."""
    if len(words) < PHRASE:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    h = _hashes(words)
    n = len(words) - PHRASE + 1
    at, flag = np.arange(n), (h & np.uint64(3)).astype(np.int8)
    function, number = (np.r_[0, np.cumsum(flag & f != 0)] for f in (FUNCTION, NUMBER))
    own = (function[at + PHRASE] == function[at]) & (number[at + PHRASE] - number[at] < PHRASE)
    return sum(h[k : k + n] * PLACES[k] for k in range(PHRASE)).view(np.int64), own


def measure(text: str | None) -> tuple[int, int, list[tuple[int, np.ndarray]]]:
    """Words, list words, and the pieces in doubt: (words, hashes of their phrases without a function word)."""
    if not text:
        return 0, 0, []
    listed = 0
    for mark, pattern in (("<", ANCHOR), ("](", MARKED), ("#", TAG)):
        found = pattern.findall(text) if mark in text else ()
        if found:
            # A link counts as the words of its label, at least as one.
            labels = [re.sub(r"<[^>]*>|\([^)]*\)", " ", m) for m in found]
            listed += sum(max(1, len(m.split())) for m in labels)
            text = pattern.sub(" ", text)
    items = PRODUCT.findall(text) if CODE.search(text) else ()
    if items:
        listed += sum(len(WORD.findall(m)) for m in items)
        text = PRODUCT.sub(" ", text)
    if ("/" in text or "www." in text.lower()) and LINK.search(text):
        lines = []
        rows = text.split("\n")
        alone = [bool(LINK.search(r)) and not WORD.search(LINK.sub(" ", r)) for r in rows]
        for i, line in enumerate(rows):
            links = len(LINK.findall(line))
            rest = LINK.sub(" ", line)
            around = WORD.findall(rest)
            if links and len(around) <= LABEL * links and not re.search(r"[.!?]", rest):
                listed += links + len(around)
            elif not links and 0 < len(around) < LEAST_WORDS and (alone[i - 1 : i] == [True] or alone[i + 1 : i + 2] == [True]) and not re.search(r"[.!?…:)\]]\s*$", line):
                # A label on the line before or after its link.
                listed += len(around)
            else:
                listed += links
                lines.append(rest)
        text = "\n".join(lines)
    total, doubt = listed, []
    for kind, run, words in _runs(PIECES.split(text)):
        piece = run[0] if len(run) == 1 else " ".join(run)
        # Letters parted by marks are one word.
        n = len(words) if sum([len(w) == 1 for w in words]) <= len(words) / 2 else max(1, len(piece.split()))
        total += n
        measured = piece
        if kind == "lines":
            # Numbers of the lines of a numbered list are not part of what recurs.
            measured = " ".join([re.sub(r"^\s*\d+[.)]\s", " ", r) for r in run])
            words = _words(measured)
        if kind == "table" or len(words) < LEAST_WORDS or _is_roll(piece) or (kind == "lines" and len(run) > 1 and _is_names(run)):
            continue
        # Single letters are mostly parts of parted words and say nothing, but elided articles count.
        # A word of a compound ("-sur-" in a name of a place) is no function word.
        longer = [w for w in (COMPOUND.findall(measured.lower()) if "-" in measured else words) if len(w) > 1]
        elided = len(ELIDED.findall(measured)) if "'" in measured or "’" in measured else 0
        function = (len([w for w in longer if w in FUNCTION_WORDS]) + elided) / max(1, len(longer) + elided)
        recur = 1 - len(set(zip(words, words[1:]))) / (len(words) - 1)
        if kind == "sentences" and (recur < OFTEN or function >= SOME):
            # Formulas of the chair: short sentences that do not recur.
            continue
        if function < FEW or recur >= OFTEN:
            listed += n
        elif function < SOME / 2 or (recur >= SOMETIMES and function < SOME):
            page, own = phrases(words)
            if own.sum() >= LISTLIKE * len(own):
                doubt.append((n, page[own]))
    return total, listed, doubt


def _lists(arrays: list[np.ndarray], dtype) -> pa.ListArray:
    ends = np.cumsum([0, *[len(a) for a in arrays]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype), *arrays])))


MEASURED = "id bigint, host string, words int, listed int, doubt array<struct<words:int,phrases:array<bigint>>>, phrases array<bigint>, places array<int>, listlike array<bigint>"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("words", pa.int32()), ("phrases", pa.list_(pa.int64()))]))
    for b in batches:
        rows, all_, places, marked = [], [], [], []
        for t in b.column("text").to_pylist():
            r = measure(t)
            page, own = phrases(_words(t or ""))
            own = np.flatnonzero(own)
            rows.append(r)
            # A host counts once for a phrase, however often a page has it.
            all_.append(np.unique(np.concatenate([page, *[p for _, p in r[2]]])))
            places.append(own.astype(np.int32))
            marked.append(page[own])
        doubt = [[{"words": n, "phrases": p.tolist()} for n, p in r[2]] for r in rows]
        columns = [b.column("id"), b.column("host"), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array(doubt, kind), _lists(all_, np.int64), _lists(places, np.int32), _lists(marked, np.int64)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MEASURED.split(", ")])


def evidence(pages: DataFrame) -> DataFrame:
    """List words of every page: (id, words, listed, stitched, replicated, share).

    ``pages`` has a unique BIGINT ``id``, ``text`` and ``host``. ``replicated``
    are words of the page in phrases without a function word that stand on other
    hosts too; ``stitched`` are words of pieces in doubt most of whose phrases
    do. A null host counts as one host. ``share`` is the part of the words that
    are listed or stitched. A null or empty text has share 0. An empty table
    gives no rows.
    """
    measured = materialize(pages.select("id", F.coalesce("host", F.lit("")).alias("host"), "text").mapInArrow(_measured, MEASURED), "measured")
    # Two hosts are told by the smallest and the largest: a state that is combined before the shuffle.
    hosts = measured.select(F.xxhash64("host").alias("host"), F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.min("host").alias("a"), F.max("host").alias("b"))
    # What stands on one host only is left out of the joins.
    spread = materialize(hosts.where("a <> b").select("phrase"), "spread")
    pieces = measured.select("id", F.posexplode("doubt").alias("piece", "d")).select("id", "piece", F.col("d.words").alias("n"), F.explode("d.phrases").alias("phrase"))
    found = pieces.join(spread.withColumn("elsewhere", F.lit(1)), "phrase", "left").groupBy("id", "piece").agg(F.max("n").alias("n"), F.count("*").alias("times"), F.count("elsewhere").alias("elsewhere"))
    stitched = found.where(F.col("elsewhere") > F.col("times") / 2).groupBy("id").agg(F.sum("n").alias("stitched"))
    marked = measured.select("id", F.explode(F.arrays_zip("places", F.col("listlike").alias("phrase"))).alias("z")).select("id", "z.places", "z.phrase").join(spread, "phrase", "left_semi")
    # Words covered: a phrase adds what the one before it does not reach.
    order = Window.partitionBy("id").orderBy("places")
    own = F.least(F.lit(PHRASE), F.coalesce(F.col("places") - F.lag("places").over(order), F.lit(PHRASE)))
    replicated = marked.select("id", own.alias("own")).groupBy("id").agg(F.sum("own").alias("replicated"))
    out = measured.select("id", "words", "listed").join(stitched, "id", "left").join(replicated, "id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("stitched", "replicated")})
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("listed") + F.col("stitched"), F.col("words")), F.lit(0.0)))


def spam_pages(pages: DataFrame) -> DataFrame:
    """The pages of which more than half the words are in lists: as :func:`evidence`."""
    return evidence(pages).where(F.col("share") > MOST)
