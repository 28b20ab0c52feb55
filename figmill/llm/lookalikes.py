"""Visually identical text brought to one form.

Every token with characters beyond ASCII is looked up in a trie of the corpus'
own spellings by a weighted edit automaton, in which look-alike letters, width
forms, ligatures and invisible characters cost nothing and the second shape of a
letter that looks like two others costs a little; of the spellings it reaches
the cheapest is taken, a plain one before others, then the most frequent.
Tokens it does not reach, and everything between tokens, go by the table.

The whole vocabulary takes part: spellings are hash-partitioned by their shape,
which is the same for all spellings the automaton can link, and each part has a
trie of its own.
"""

from __future__ import annotations

import hashlib
import itertools
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figmill.llm.skew import hot_keys, split_join
from figmill.plans.lineage import cut, release, spread

# Letters of other scripts and the Latin letters of the same shape.
GREEK_FROM = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϲϳ"
GREEK_TO = "ABEZHIKMNOPTYXovpcj"
CYRILLIC_FROM = "АВЕЅІЈКМНОРСТУХҮԌԜԚаеорсухѕіјһԁԛԝӏ"
CYRILLIC_TO = "ABESIJKMHOPCTYXYGWQaeopcyxsijhdqwl"
OTHER_FROM = "ɡɑıϜՕՏօսցհոԼ"
OTHER_TO = "gaiFOSougհnL"
# Characters without a mark of their own.
IGNORABLE = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F,
             0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x2066, 0x2067, 0x2068, 0x2069, 0xFEFF, 0xFE00, 0xFE0E, 0xFE0F]
# Hyphens of one shape.
HYPHENS = [0x2010, 0x2011, 0xFE63, 0xFF0D]

ZWJ, KEPT_ZWJ = "\u200d", "\ue000"

# Letters that look like two Latin ones, the nearer shape first.
TWO_SHAPES = {"\u04c0": "Il", "\u04cf": "lI", "\u0406": "Il", "\u0399": "Il"}

#: Cost of the second shape, and of the edits that a token's spelling may cost.
SECOND, BUDGET = 0.25, 0.5
#: Texts without a character beyond ASCII.
PLAIN = r"^[\x00-\x7f]*$"
#: Spellings per trie.
TRIE_WORDS = 50_000


@cache
def table() -> dict[int, str]:
    """Code points and what they count as, built by rule from Unicode's decompositions.

    Width, no-break and ligature forms become what they stand for; every space
    separator a space; the lists above are added.  Superscripts, circled and
    other visibly different forms are left as they are.
    """
    out: dict[int, str] = {}
    for c in range(0x80, 0x30000):
        ch = chr(c)
        kind = unicodedata.decomposition(ch)
        if kind.startswith(("<wide>", "<narrow>", "<noBreak>")) or 0xFB00 <= c <= 0xFB06 or 0xFB13 <= c <= 0xFB17 or c in (0x00B5, 0x2126, 0x212A, 0x212B):
            out[c] = unicodedata.normalize("NFKC", ch)
        if unicodedata.category(ch) == "Zs":
            out[c] = " "
    out |= {c: "" for c in IGNORABLE} | {c: "-" for c in HYPHENS}
    out |= {ord(a): b for a, b in zip(GREEK_FROM + CYRILLIC_FROM + OTHER_FROM, GREEK_TO + CYRILLIC_TO + OTHER_TO) if a != b}
    return out


def _is_picture(ch: str) -> bool:
    return ord(ch) >= 0x1F000 or 0x2600 <= ord(ch) <= 0x27BF or ch == "\ufe0f"


def by_table(text: str) -> str:
    """The form of a text by the table alone: the same for all texts that look alike."""
    if text.isascii():
        return text
    t = unicodedata.normalize("NFD", text)
    if ZWJ in t:
        # a joiner between pictures changes what is seen; a private character stands in for it
        t = "".join(KEPT_ZWJ if ch == ZWJ and 0 < i < len(t) - 1 and _is_picture(t[i - 1]) and _is_picture(t[i + 1]) else ch for i, ch in enumerate(t))
    # twice, as a width form may stand for a letter that the table lists too
    t = unicodedata.normalize("NFD", t.translate(table())).translate(table())
    return unicodedata.normalize("NFC", t).replace(KEPT_ZWJ, ZWJ)


@cache
def _shapes(ch: str) -> tuple[tuple[str, float], ...]:
    """What a character may count as, and at what cost."""
    if ch in TWO_SHAPES:
        return tuple(zip(TWO_SHAPES[ch], (0.0, SECOND)))
    return ((unicodedata.normalize("NFD", unicodedata.normalize("NFD", ch).translate(table())).translate(table()), 0.0),)


def shape(token: str) -> str:
    """The key that all spellings share which the automaton may link within BUDGET."""
    return by_table(token).translate({ord("I"): "l", 0x04C0: "l"})


class SpellingTrie:
    """Trie of spellings with a weighted edit automaton over it."""

    def __init__(self, words: list[tuple[str, int]]):
        # a node: children by character, and the spelling that ends here with its rank
        self.root: dict = {}
        seen: set[str] = set()
        for word, count in words:
            node = self.root
            for ch in unicodedata.normalize("NFD", word):
                seen.add(ch)
                node = node.setdefault(ch, {})
            end = (not word.isascii(), -count, word)
            if "" not in node or end < node[""]:
                node[""] = end
        self.alike: dict[str, list[str]] = {}
        for ch in seen:
            nearest = _shapes(ch)[0][0]
            if len(nearest) <= 1:
                self.alike.setdefault(nearest, []).append(ch)

    def spell(self, token: str, budget: float = BUDGET) -> str | None:
        """The spelling within ``budget`` of the token: the cheapest, then a plain one, then the most frequent, then the smallest.

        Ignorables and look-alikes cost 0, the second shape of a letter SECOND, any
        other insertion, deletion or substitution 1.
        """
        states: list[tuple[float, dict]] = self._skips([(0.0, self.root)], budget)
        for raw in unicodedata.normalize("NFD", token):
            reached: list[tuple[float, dict]] = []
            for text, weight in _shapes(raw):
                now = [(cost + weight, node) for cost, node in states if cost + weight <= budget] if weight else states
                for ch in text:
                    after: list[tuple[float, dict]] = []
                    for cost, node in now:
                        for same in self.alike.get(ch, ()):
                            if same in node:
                                after.append((cost, node[same]))
                        if cost + 1 <= budget:
                            after.append((cost + 1, node))
                            after += [(cost + 1, child) for k, child in node.items() if k and k not in self.alike.get(ch, ())]
                    now = self._skips(after, budget)
                reached += now
            states = self._skips(reached, budget) if len(_shapes(raw)) > 1 else reached
            if not states:
                return None
        ends = [(cost, *node[""]) for cost, node in states if "" in node]
        return min(ends)[3] if ends else None

    @staticmethod
    def _skips(states: list[tuple[float, dict]], budget: float) -> list[tuple[float, dict]]:
        """One state per node, at its least cost, with the nodes reached by leaving out trie characters."""
        if len(states) == 1 and states[0][0] + 1 > budget:
            return states
        best: dict[int, tuple[float, dict]] = {}
        todo = sorted(states, key=lambda s: s[0])
        while todo:
            cost, node = todo.pop(0)
            if id(node) in best and best[id(node)][0] <= cost:
                continue
            best[id(node)] = (cost, node)
            if cost + 1 <= budget:
                todo += [(cost + 1, child) for k, child in node.items() if k]
        return list(best.values())


@cache
def _tokens():
    import regex

    ignorable = "".join(f"\\u{c:04x}" for c in IGNORABLE)
    return regex.compile(rf"[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}\p{{M}}_{ignorable}]*")


@cache
def _foreign_tokens():
    """The same tokens, only those with a character beyond ASCII."""
    import regex

    ignorable = "".join(f"\\u{c:04x}" for c in IGNORABLE)
    more = rf"[\p{{L}}\p{{N}}\p{{M}}_{ignorable}]"
    return regex.compile(rf"(?<![A-Za-z0-9_])(?:[A-Za-z0-9_]++(?=[^\x00-\x7f]){more}|(?=[^\x00-\x7f])[\p{{L}}\p{{N}}]){more}*")


def rewritten(text: str, spellings: dict[str, str]) -> str:
    """A text with its foreign tokens in the given spellings, and all else by the table."""
    if text.isascii():
        return text
    out, end = [], 0
    for m in _foreign_tokens().finditer(text):
        spelled = spellings.get(m.group())
        if spelled is not None:
            out += [by_table(text[end:m.start()]), spelled]
            end = m.end()
    out.append(by_table(text[end:]))
    joined = "".join(out)
    return joined if joined.isascii() else unicodedata.normalize("NFC", joined)


class Canonical:
    """Texts in one form by a vocabulary that fits into one trie."""

    def __init__(self, words: list[tuple[str, int]]):
        self.trie = SpellingTrie(words)

    def text(self, text: str) -> str:
        found = {t: self.trie.spell(t) for t in set(_foreign_tokens().findall(text))}
        return rewritten(text, {t: s for t, s in found.items() if s is not None})


@cache
def _unclean() -> frozenset:
    return frozenset(chr(c) for c, v in table().items() if v == "" or unicodedata.decomposition(chr(c)).startswith("<"))


_OTHER_SCRIPTS = frozenset(GREEK_FROM + CYRILLIC_FROM + OTHER_FROM) | TWO_SHAPES.keys()


def is_clean(word: str) -> bool:
    """Whether a spelling may stand for others: composed, without ignorable, width or ligature forms, and no Latin word with letters of another script."""
    if word.isascii():
        return True
    if not unicodedata.is_normalized("NFC", word) or not _unclean().isdisjoint(word):
        return False
    parts = unicodedata.normalize("NFD", word)
    return _OTHER_SCRIPTS.isdisjoint(parts) or not any(ch.isascii() and ch.isalpha() for ch in parts)


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n, shape``: every token of all texts, counted per Arrow batch and summed in Spark."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for t in b.column(0).to_pylist():
                if t:
                    n.update(_tokens().findall(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([shape(w) for w in n], pa.string())], names=["word", "n", "shape"])

    counts = docs.select(F.col(text).alias("t")).where("t is not null and t <> ''").mapInArrow(count, "word string, n bigint, shape string")
    return counts.groupBy("word", "shape").agg(F.sum("n").alias("n"))


def spellings(words: DataFrame) -> DataFrame:
    """``token, spelling``: what the automaton makes of every token beyond ASCII, over the whole vocabulary, where the table would not say the same.

    Spellings of one shape are in one part, and a part has about TRIE_WORDS of
    them.  Plain tokens keep their spelling, as a plain one comes first.
    """
    foreign = words.where(~F.col("word").rlike(PLAIN)).select("shape").distinct()
    used = words.join(foreign, "shape", "left_semi")
    parts = max(1, -(-words.count() // TRIE_WORDS), int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(part: pa.Table) -> pa.Table:
        ws, n = part.column("word").to_pylist(), part.column("n").to_pylist()
        trie = SpellingTrie([(w, k) for w, k in zip(ws, n) if is_clean(w)])
        found = [(w, trie.spell(w)) for w in ws if not w.isascii()]
        found = [(w, x) for w, x in found if x is not None and x != by_table(w)]
        return pa.table({"token": pa.array([w for w, _ in found], pa.string()), "spelling": pa.array([x for _, x in found], pa.string())})

    return used.select("word", "n", F.pmod(F.xxhash64("shape"), F.lit(parts)).alias("part")).groupBy("part").applyInArrow(run, "token string, spelling string")


def canonical_texts(docs: DataFrame, ident: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """``ident, canonical``: each text in the one form of all texts that look like it.

    Null stays null and empty stays empty; a text of ignorables only becomes
    empty.  Letter case, accents, raised digits and line ends are kept.  Repeated
    rows give repeated rows; other columns are not read.  With ``digests`` the
    columns are ``form`` and ``stored``, SHA-256 digests of the canonical and the
    stored text, instead of the text.
    """
    rows = docs.select(F.col(ident).alias("ident"), F.col(text).alias("text"))
    plain = F.col("text").isNull() | F.col("text").rlike(PLAIN)
    foreign = spread(rows.where(~plain), "ident").withColumn("stored", F.sha2("text", 256))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list(set(_foreign_tokens().findall(t))) for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(list(itertools.chain(*found)), pa.string())], names=["stored", "token"])

    words = cut(vocabulary(docs, text), "vocabulary")
    spelled = cut(spellings(words), "spellings")
    held = foreign.select("stored", "text").mapInArrow(tokens, "stored string, token string")
    # how often a token stands in the texts is known from the vocabulary
    hot = hot_keys(words.join(spelled.select(F.col("token").alias("word")), "word", "left_semi"), "word", "n")
    lists = cut(split_join(held, spelled, "token", hot=hot).groupBy("stored").agg(F.collect_set(F.struct("token", "spelling")).alias("spelled")), "spelled")
    release(words, spelled)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [rewritten(t, {x["token"]: x["spelling"] for x in s or ()}) for t, s in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
            if digests:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sha(f) for f in forms], pa.string()), b.column(2)], names=["ident", "form", "stored"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.string())], names=["ident", "canonical"])

    names = ["form", "stored"] if digests else ["canonical"]
    schema = T.StructType([T.StructField("ident", docs.schema[ident].dataType), *[T.StructField(n, T.StringType()) for n in names]])
    done = split_join(foreign, lists, "stored", "left").select("ident", "text", "stored", "spelled").mapInArrow(run, schema)
    kept = rows.where(plain)
    kept = kept.select("ident", F.sha2("text", 256).alias("form"), F.sha2("text", 256).alias("stored")) if digests else kept.select("ident", F.col("text").alias("canonical"))
    return done.unionByName(kept).withColumnRenamed("ident", ident)


def same_to_the_eye(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_a, doc_b``: texts that differ as stored and look the same, doc_a < doc_b.

    Null and empty texts take no part.  Exact copies are one class; only classes
    of one form are paired, so a text that a third of all rows repeat is compared
    once, and the rows of such a class are split when its pairs are written out.
    """
    keyed = cut(canonical_texts(docs.where(F.col(text).isNotNull() & (F.col(text) != "")), ident, text, digests=True).withColumnRenamed(ident, "id"))
    classes = keyed.groupBy("form", "stored").agg(F.count(F.lit(1)).alias("n"))
    a = classes.select("form", F.col("stored").alias("sa"))
    b = classes.select("form", F.col("stored").alias("sb"))
    pairs = a.join(b, "form").where("sa < sb").select("sa", "sb")
    left, right = keyed.select(F.col("stored").alias("sa"), F.col("id").alias("ia")), keyed.select(F.col("stored").alias("sb"), F.col("id").alias("ib"))
    out = split_join(right, split_join(left, pairs, "sa"), "sb")
    return out.select(F.least("ia", "ib").alias("doc_a"), F.greatest("ia", "ib").alias("doc_b")).where("doc_a < doc_b")


def form_sql(column: str) -> str:
    """The form by the table as SQL of DuckDB: a composed text, letters replaced one by one, composed again."""
    single: list[tuple[str, str]] = []
    several: list[tuple[str, str]] = []
    for c in range(0x80, 0x30000):
        ch = chr(c)
        to = by_table(ch)
        if to != unicodedata.normalize("NFC", ch) and to != "" and unicodedata.is_normalized("NFC", ch):
            (single if len(to) == 1 else several).append((ch, to))
    picture = "[\\x{2600}-\\x{27bf}\\x{fe0f}\\x{1f000}-\\x{10ffff}]"
    gone = "".join(f"\\x{{{c:x}}}" for c in IGNORABLE)
    x = f"nfc_normalize({column})"
    for _ in range(2):
        x = f"regexp_replace({x}, '({picture})\\x{{200d}}({picture})', '\\1\ue000\\2', 'g')"
    x = f"regexp_replace({x}, '[{gone}]', '', 'g')"
    for ch, to in several:
        x = f"replace({x}, '{ch}', '{to}')"
    x = "translate({}, '{}', '{}')".format(x, "".join(a for a, _ in single), "".join(b for _, b in single).replace("'", "''"))
    return f"replace(nfc_normalize({x}), '\ue000', '\u200d')"
