"""Texts that lost their end: hidden length limits of sources, and endings that stop inside a word or sentence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftline.llm.bloom import BloomFilter, bloom_filter
from weftline.llm.words import BASE, WordHashes, portions
from weftline.plans.bounded import small_side
from weftline.plans.durable import materialize

#: Numbers of last words whose continuation in all texts is counted; the longest one seen often enough decides.
CONTEXTS = (1, 2, 3, 4, 5, 7, 10)
#: Contexts for which words that begin with the last word are counted too.
BEGUN = (2, 3)
#: Times a context must occur elsewhere before it decides.
SUPPORT = 3
#: Share of ends after a context below which a text stopped there is cut; the second for texts at an exposed limit.
OPEN, OPEN_AT_LIMIT = 0.15, 0.75

_TAG, _ENTITY = re.compile(r"<[^<>]*>"), re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z]\w*);")
_TOKEN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*|[.!?…]+|[^\w\s]")
_MARKS = re.compile(r"(?:[\s�]|\.{2,}|…|<[^<>]*$|&[#\w]*$)+$")
_PIECE = re.compile(r"&[#\w]*")
_INNER = frozenset(",;:()«»\"'“”„—–-/%№°*+=&_[]")
_END = "\0"


def core_text(text: str) -> str:
    """The text without markup and without what a loss may leave at its very end: dots, damaged characters, a piece of a tag or entity, blanks."""
    t = _ENTITY.sub(" ", _TAG.sub(" ", text)) if "<" in text or "&" in text else text
    while _marked(t) and (m := _MARKS.search(t)):
        t = t[: m.start()]
    return t


def _marked(t: str) -> bool:
    """Whether something of ``_MARKS`` may stand at the end (a quick look)."""
    last = t[-1:]
    return last.isspace() or last in ("�", "…") or t.endswith("..") or t.rfind("<") > t.rfind(">") or ("&" in t and _PIECE.fullmatch(t, t.rfind("&")) is not None)


class Vocabulary(dict):
    """Number of each word, sign or sentence end as it is written, and what it stands for.

    A text is read as words (lower case; numbers as "0"; capitalised words inside a sentence as one class), inner punctuation, and sentence
    ends, with one end before the first word. A word has one hash at the start of a sentence and one inside. With ``pieces`` the beginnings of words that
    pass that filter are kept too. Everything is forgotten when it grows too large.
    """

    def __init__(self, pieces: BloomFilter | None = None, most: int = 500_000):
        super().__init__()
        self.pieces, self.most, self.hashes = pieces, most, WordHashes(most)
        self.end = np.uint64(self.hashes[_END])
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[tuple[str, str, int]] = []  # what stands for the newest ones, at the start of a sentence and inside; 0 word, 1 inner punctuation, 2 sentence end
        self.kind, self.hash = np.zeros(0, np.int8), np.zeros((0, 2), np.uint64)
        self.begun, self.offset = np.zeros(0, np.uint64), np.zeros(1, np.int64)  # kept beginnings of all words, and where each word's start
        self.changes = np.zeros(0, bool)  # stands for something else inside a sentence

    def __missing__(self, w: str) -> int:
        c = w[0]
        if c.isalnum():
            first = "0" if c.isdigit() else w.lower()
            self.new.append((first, "\1" if c.isupper() and not w.isupper() else first, 0))
        else:
            sign = w if c in _INNER else _END
            self.new.append((sign, sign, 1 if c in _INNER else 2))
        n = self[w] = len(self)
        return n

    def _learn(self) -> None:
        """Tables of the newest entries, made together."""
        if not self.new:
            return
        first, inside, kind = zip(*self.new)
        self.new = []
        self.kind = np.concatenate([self.kind, np.array(kind, np.int8)])
        self.hash = np.concatenate([self.hash, np.stack([self.hashes.of(first), self.hashes.of(inside)], 1)])
        self.changes = np.concatenate([self.changes, np.array([a != b for a, b in zip(first, inside)])])
        size = np.array([len(w) - 1 if self.pieces is not None and w[0].isalpha() else 0 for w in first])
        h = self.hashes.of([w[:j] for w, n in zip(first, size.tolist()) for j in range(1, n + 1)])
        word = np.repeat(np.arange(len(first)), size)
        if len(h):
            kept = self.pieces.passes(h)
            h, word = h[kept], word[kept]
        self.begun = np.concatenate([self.begun, h])
        self.offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum(np.bincount(word, minlength=len(first)))])

    def read(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, whether each stands at the start of a sentence, hashes, tokens per text) of the texts one after the other."""
        if len(self) > self.most:
            self.forget()
        written: list[str] = []
        size = np.zeros(len(cores), np.int64)
        for i, core in enumerate(cores):
            before = len(written)
            written.append(_END)
            written += _TOKEN.findall(core)
            size[i] = len(written) - before
        ids = np.fromiter(map(self.__getitem__, written), np.int64, len(written))
        self._learn()
        seen = np.maximum.accumulate(np.where(self.kind[ids] != 1, np.arange(len(ids)), 0))  # the last word or end so far
        start = np.ones(len(ids), bool)
        start[1:] = self.kind[ids[seen[:-1]]] == 2
        return ids, start, self.hash[ids, np.where(start, 0, 1)], size

    def beginnings(self, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the kept beginnings of the words read."""
        n = np.where(start | ~self.changes[ids], (self.offset[1:] - self.offset[:-1])[ids], 0)
        at = np.flatnonzero(n)
        n = n[at]
        into = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.begun[np.repeat(self.offset[ids[at]], n) + into]


def _contexts(h: np.ndarray, end: np.uint64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each context length: (length, hash at every place, to be mixed with the length, whether the context lies inside one sentence, its start mark included)."""
    n = len(h)
    at = np.arange(n)
    since = at - np.maximum.accumulate(np.where(h == end, at, -1))
    acc, power = np.zeros(n, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for q in range(1, min(n, max(CONTEXTS)) + 1):
            acc[q - 1 :] += h[: n - q + 1] * power
            power = power * np.uint64(BASE)
            if q in CONTEXTS:
                yield q, acc, (since >= q - 1) & (since > 0) & (at >= q - 1)


def _statistics(asked: BloomFilter, pieces: BloomFilter):
    """Per portion of texts, summed: how often a context is followed by a sentence end (e) or goes on (c), and how often its last word goes on as a longer word (l).

    Only contexts that pass ``asked`` are counted, and only beginnings of words that pass ``pieces`` are looked at.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(pieces)
        for rows in portions(it, 0):
            ids, start, h, size = vocabulary.read([core_text(t) for (t,) in rows])
            end = vocabulary.end
            inner = np.ones(len(h), bool)
            inner[np.cumsum(size) - 1] = False  # what follows a text's last word is unknown
            ends = np.r_[h[1:] == end, True]
            place, piece = vocabulary.beginnings(ids, start)
            keys, closed, longer = [], [], []

            def add(k, e, lo):
                keys.append(k)  # noqa: B023
                closed.append(e)  # noqa: B023
                longer.append(lo)  # noqa: B023

            for q, k, ok in _contexts(h, end):
                ok &= inner
                at = np.flatnonzero(ok)
                key = _mixed(k[at], q)
                hit = asked.passes(key)
                add(key[hit], ends[at[hit]].astype(np.int8), np.zeros(int(hit.sum()), np.int8))
                if q in BEGUN and len(place):
                    of = ok[place]
                    with np.errstate(over="ignore"):
                        key = _mixed(k[place[of]] - h[place[of]] + piece[of], q)
                    key = key[asked.passes(key)]
                    add(key, np.zeros(len(key), np.int8), np.ones(len(key), np.int8))
            k, e, lo = (np.concatenate(x) for x in (keys, closed, longer)) if keys else (np.zeros(0, np.uint64), *[np.zeros(0, np.int8)] * 2)
            u, inv = np.unique(k, return_inverse=True)
            total = lambda x: np.bincount(inv, x, len(u)).astype(np.int64)  # noqa: B023, E731
            n = [total(e), total((e == 0) & (lo == 0)), total(lo)]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *map(pa.array, n)], ["key", "e", "c", "l"])

    return run


def _mixed(acc: np.ndarray, q: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (acc ^ (acc >> np.uint64(29))) * np.uint64(2 * q + 0x9E3779B97F4A7C01)


def _list_array(values: np.ndarray, mask: np.ndarray) -> pa.ListArray:
    """For each row of ``mask`` the list of the values it marks."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(mask.sum(1))].astype(np.int32)), pa.array(values[mask]))


def _endings(vocabulary: Vocabulary, cores: list[str], partial: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text: whether its end is known, whether it is open, the keys of its end's contexts, which of them lie inside one sentence, and its last token's hash.

    ``partial`` texts are ends of longer ones: their first word may be a piece and isn't used, and no sentence starts there; with too few words
    after it their end isn't known.
    """
    ids, _, h, size = vocabulary.read(cores)
    last = np.cumsum(size) - 1
    first = last - size + 1
    if partial.any():
        at = np.arange(len(ids))
        ahead = np.minimum.accumulate(np.where(vocabulary.kind[ids] != 1, at, len(at))[::-1])[::-1]  # the next word or end
        first = np.where(partial, np.r_[ahead, len(at)][first + 1] + 1, first)
    count = np.maximum(last - first + 1, 0)
    mark = np.maximum.accumulate(np.where(h == vocabulary.end, np.arange(len(h)), -1))[last]
    since = np.where(mark < first, np.iinfo(np.int64).max, last - mark)
    open_ = (count > 1) & (since > 0)
    known = ~partial | (mark >= first) | (count > max(CONTEXTS))
    keys, inside = np.zeros((len(cores), len(CONTEXTS)), np.int64), np.zeros((len(cores), len(CONTEXTS)), bool)
    acc, power = np.zeros(len(cores), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for q in range(1, max(CONTEXTS) + 1):
            acc = acc + h[np.maximum(last - q + 1, 0)] * power
            power = power * np.uint64(BASE)
            if q in CONTEXTS:
                i = CONTEXTS.index(q)
                keys[:, i], inside[:, i] = _mixed(acc, q).view(np.int64), open_ & (since >= q - 1) & (count >= q)
    return known, open_, keys, inside, h[last]


#: Characters at the end of a text that are read for its last words; the whole text is read where they hold too few words.
_SPAN = 200


def _tails(kind: pa.DataType):
    """Per text: its lengths, whether it stops without a sentence end, its end's contexts, its last word, and a hash that copies share."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for rows in portions(it, 2):
            ids, sources, texts = zip(*rows)
            cores = [core_text(t) for t in texts]
            partial = np.array([len(c) > _SPAN for c in cores])
            known, open_, keys, inside, last = _endings(vocabulary, [c[-_SPAN:] for c in cores], partial)
            short = np.flatnonzero(~known)
            if len(short):
                _, open_[short], keys[short], inside[short], last[short] = _endings(vocabulary, [cores[i] for i in short.tolist()], np.zeros(len(short), bool))
            own = [xxhash.xxh3_64_intdigest(c) - (1 << 63) for c in cores]
            size = np.array([lengths(t) for t in texts], np.int32)
            q = np.broadcast_to(np.array(CONTEXTS, np.int32), keys.shape)
            cols = [pa.array(ids, kind), pa.array(sources, pa.string()), _list_array(size, np.ones(size.shape, bool)), pa.array(open_), _list_array(keys, inside), _list_array(q, inside), pa.array(last.view(np.int64), mask=~open_), pa.array(own, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "source", "lengths", "open", "keys", "sizes", "last", "own"])

    return run


#: Lengths of a text as different writers would have stored it.
MEASURES = ("chars", "utf8", "utf16", "chars_html", "utf8_html", "chars_json", "utf8_json", "ascii_json", "chars_crlf", "utf8_crlf", "chars_br")


def lengths(text: str) -> list[int]:
    """The lengths named in ``MEASURES``: characters and bytes plain, with entities, with JSON escapes, with two-byte and marked-up line ends."""
    n = utf8 = units = ascii_ = len(text)
    if not text.isascii():
        utf8, units, ascii_ = len(text.encode("utf-8", "replace")), len(text.encode("utf-16-le", "replace")) // 2, len(text.encode("ascii", "ignore"))
    quotes, feeds = text.count('"'), text.count("\n")
    html = 4 * text.count("&") + 3 * (text.count("<") + text.count(">")) + 5 * quotes
    json = quotes + feeds + text.count("\\") + text.count("\t") + text.count("\r")
    lines = feeds - text.count("\r\n")
    return [n, utf8, units, n + html, utf8 + html, n + json, utf8 + json, ascii_ + json + 6 * (units - ascii_), n + lines, utf8 + lines, n + 3 * lines]


def text_tails(documents: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``lengths`` (by measure), ``open`` (no sentence end at the end), contexts and hash of the last words.

    NULL texts and NULL ids are left out; a text without any word is not open.
    """
    src = documents.select(F.col(doc).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    kind = src.schema["doc_id"].dataType
    return src.mapInArrow(_tails(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, source string, lengths array<int>, open boolean, keys array<long>, sizes array<int>, last long, own long")


def exposed_limits(tails: DataFrame, least: int = 4, times: float = 5.0, reach: int = 25) -> DataFrame:
    """``source``, ``measure``, ``length``, ``n``, ``n_open``: lengths at which a source piles up unfinished texts.

    Counts are of different texts: copies in a source count once, before the lengths are spread out.
    A length counts as a storage limit if at least ``least`` texts have it, at least half of
    them without a sentence end, and ``times`` as many as an average length
    within ``reach`` of it. Only the table of length counts is sorted; it has at most as
    many rows per source and measure as there are lengths.
    """
    texts = tails.groupBy("source", "own", "lengths").agg(F.max("open").alias("open"))
    one = texts.select("source", "own", "open", F.posexplode("lengths").alias("m", "length")).distinct()
    n = one.groupBy("source", "m", "length").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("open").cast("long")).alias("n_open"))
    near = Window.partitionBy("source", "m").orderBy("length").rangeBetween(-reach, reach)
    usual = (F.sum("n").over(near) - F.col("n")) / (2.0 * reach)
    hit = n.withColumn("usual", usual).filter((F.col("n_open") >= least) & (2 * F.col("n_open") >= F.col("n")) & (F.col("n") >= times * F.greatest("usual", F.lit(0.2))))
    return hit.select("source", F.element_at(F.array(*[F.lit(x) for x in MEASURES]), F.col("m") + 1).alias("measure"), "m", "length", "n", "n_open")


def truncated_documents(documents: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``truncated`` of every document with id and text.

    Lengths are recomputed under several encodings, escapings and newline
    forms; per source and measure, lengths at which unfinished texts pile up are exposed
    as hidden limits. Then endings are inspected: marks that a loss leaves are
    taken off, and a text without a sentence end is held against all texts.
    It stops inside a word if after the same one or two words the corpus has far more longer words that
    begin with its last word than that word itself; it stops inside a sentence if after its
    last words (the longest of 1 to 10 words that occur ``SUPPORT`` times elsewhere) sentences
    hardly ever end. Ends without punctuation count as ends when other, different texts end so
    too; copies count once. Texts at an exposed limit need clearer proof of being complete, and are
    cut when nothing is known of their ending.

    Empty texts and texts without words are never truncated. Statistics
    cover all texts; the contexts that open texts end with go to the workers as a Bloom filter of bounded size, so only
    counts of these (and of the few others that pass) are summed per portion and shuffled. Repeated ids give repeated rows.
    """
    tails = materialize(text_tails(documents, doc, text, source), "tails")
    limits = materialize(exposed_limits(tails), "limits").select(F.col("source").alias("ls"), F.col("m").alias("lm"), F.col("length").alias("ll"))
    open_ = tails.filter("open")
    asked_keys, pieces = bloom_filter(open_.select(F.explode("keys").alias("key")), "key"), bloom_filter(open_, "last")
    stats = documents.select(F.col(text).alias("text")).filter("text is not null").mapInArrow(_statistics(asked_keys, pieces), "key long, e long, c long, l long").withColumn("d", F.lit(0).cast("long"))
    ends = open_.select("own", F.explode("keys").alias("key")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("d"))
    zero = [F.lit(0).cast("long").alias(x) for x in "ecl"]
    known = stats.unionByName(ends.select("key", *zero, "d")).groupBy("key").agg(*[F.sum(x).alias(x) for x in "ecld"]).withColumnRenamed("key", "k")
    asked = open_.select("own", F.explode(F.arrays_zip("sizes", "keys")).alias("x")).select("own", F.col("x.sizes").alias("q"), F.col("x.keys").alias("key")).distinct()
    met = asked.join(known.filter("d > 0"), F.col("key") == F.col("k"))
    elsewhere = F.col("e") + F.col("c") + F.col("d") - 1
    inside_word = F.max(F.col("q").isin(*BEGUN) & (F.col("l") >= 4 * (F.col("e") + F.col("c") + 1)) & (F.col("l") > F.col("d")))
    longest = F.max(F.when(elsewhere >= SUPPORT, F.struct("q", ((F.col("e") + F.col("d") - 1) / elsewhere).alias("ends"))))
    verdict = met.groupBy(F.col("own").alias("o")).agg(inside_word.alias("inside_word"), longest.alias("longest"))
    at_limit = open_.select("doc_id", "source", F.posexplode("lengths").alias("m", "length"))
    at_limit = at_limit.join(small_side(limits), F.col("source").eqNullSafe(F.col("ls")) & (F.col("m") == F.col("lm")) & (F.col("length") == F.col("ll"))).select(F.col("doc_id").alias("ld")).distinct()
    judged = tails.join(verdict, F.col("open") & (F.col("own") == F.col("o")), "left").join(at_limit, F.col("doc_id") == F.col("ld"), "left")
    bar = F.when(F.col("ld").isNotNull(), F.lit(OPEN_AT_LIMIT)).otherwise(F.lit(OPEN))
    cut = F.col("open") & (F.coalesce("inside_word", F.lit(False)) | F.coalesce(F.col("longest.ends") < bar, F.col("ld").isNotNull()))
    return judged.select("doc_id", "source", cut.alias("truncated"))


def truncation_report(documents: DataFrame, **kw) -> DataFrame:
    """Per source: documents, truncated documents and their share."""
    t = truncated_documents(documents, **kw)
    n = F.count(F.lit(1))
    cut = F.sum(F.col("truncated").cast("long"))
    return t.groupBy("source").agg(n.alias("documents"), cut.alias("truncated"), F.round(cut / n, 6).alias("share"))
