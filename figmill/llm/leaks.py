"""Evaluation passages inside corpus documents, by latent semantic retrieval.

Texts become sequences of words that ignore case, punctuation, spacing, line
breaks and prefixes, and look-alikes.  Overlapping passages of the corpus and
of the items are TF-IDF vectors; a distributed randomised SVD gives one latent
space for all of them.  Item passages lie in cells of that space; a passage of a
document looks only into cells whose centre is as near as a contained run of
words would bring it, and is a candidate for the item passages there whose
cosine is no less than such a run would give.  Candidates for paraphrases are
also all passages that hold enough of an item passage's rarest words, a bound
that no paraphrase can miss.  Each candidate is then checked word by word: a
common run, and for paraphrases the longest common subsequence together with
the item's answer.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.llm.lookalikes import by_table
from figmill.plans.lineage import cut, spread

#: Words that make a leak.
RUN = 12
#: Document passages: two neighbouring blocks of STRIDE words.  Any RUN words lie inside one.
PASSAGE, STRIDE = 24, 12
#: Item passages: the same for the items.
ITEM_PASSAGE, ITEM_STRIDE = 18, 6
#: Hashed features of the TF-IDF matrix, rank of the latent space, and columns drawn beyond it.
FEATURES, RANK, EXTRA = 8192, 96, 16
#: Share of the product that a contained run has with its item passage at which a pair is a candidate,
#: and of the product it has with a cell's centre at which the cell is searched.
SHARE, CELL_SHARE = 0.85, 0.75
#: Share of an item passage, as longest common subsequence, that makes a paraphrase.
PARAPHRASE = 0.8
#: Rare words of an item passage that are looked for.  A paraphrase misses at most n - least_common(n)
#: of the n words, so of its n - least_common(n) + SURE rarest ones it holds SURE or more.
SURE = 7
#: Items per broadcast: this many items are searched in one pass over the corpus, all in the same latent space.
ITEM_BLOCK = 5_000
#: Words handled at once by a worker, and candidates checked at once.
CHUNK, CHECKED = 49_152, 8_192
#: Shares of the corpus sum that one task adds up.
FAN_IN = 32

_WORDS = re.compile(r"[^\W_]+")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


def words(text: str | None) -> list[str]:
    """Words of a text in their comparable form; Unicode escapes of JSON records are read."""
    if not text:
        return []
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m.group(1), 16)), text)
    return _WORDS.findall(by_table(text).casefold())


_KNOWN: dict[str, int] = {}


def _codes(ws: list[str]) -> list[int]:
    """64-bit codes of words, equal wherever they are computed."""
    out = []
    for w in ws:
        c = _KNOWN.get(w)
        if c is None:
            if len(_KNOWN) > 500_000:
                _KNOWN.clear()
            c = _KNOWN[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        out.append(c)
    return out


def word_codes(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """``id, w``: the codes of each text's words (empty for null and empty texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_codes(words(t)) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["id", "w"])

    return spread(docs.select(F.col(ident).cast("bigint").alias("id"), F.col(text).alias("text")), "id").mapInArrow(run, "id bigint, w array<bigint>")


def starts(n: int, size: int, stride: int) -> np.ndarray:
    """Starts of the passages of n words; the last reaches the end."""
    if n <= size:
        return np.zeros(1 if n else 0, np.int64)
    s = np.arange(0, n - size + stride, stride)
    s[-1] = n - size if s[-1] > n - size else s[-1]
    return s


class Chunk:
    """A stretch of a column of word codes in blocks of STRIDE words, with the passages that begin in it.

    ``first`` is the block each passage begins with and ``lone`` tells that it has
    no second one; the last block of a stretch may belong to the next one too, so
    that every passage lies in one stretch, however long its text.
    """

    def __init__(self, w: np.ndarray, begin: np.ndarray, first: np.ndarray, lone: np.ndarray, row: np.ndarray):
        self.w, self.begin, self.first, self.lone, self.row = w, begin, first, lone, row

    def sums(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the words' rows of a table, by block and by passage."""
        blocks = np.add.reduceat(table[_feature(self.w)], self.begin, axis=0)
        out = blocks[self.first]
        two = ~self.lone
        out[two] += blocks[self.first[two] + 1]
        return blocks, out

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """PASSAGE words of each of the given passages, and which of them there are."""
        i = self.first[at]
        end = np.append(self.begin, len(self.w))[np.where(self.lone[at], i + 1, i + 2)]
        place = self.begin[i][:, None] + np.arange(PASSAGE)
        return self.w[np.minimum(place, len(self.w) - 1)], place < end[:, None]


def _chunks(column: pa.Array) -> Iterator[Chunk]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    length = np.diff(column.offsets.to_numpy())
    count = -(-length // STRIDE)
    row = np.repeat(np.arange(len(length)), count)
    if not len(row):
        return
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(length) - length, count) + place * STRIDE
    last = np.append(row[1:] != row[:-1], True)
    for a in range(0, len(row), CHUNK // STRIDE):
        e = min(a + CHUNK // STRIDE, len(row))
        h = e if last[e - 1] else e + 1
        lone = last[a:e] & (place[a:e] == 0)
        first = np.flatnonzero(~last[a:e] | lone)
        yield Chunk(flat[begin[a]:begin[h] if h < len(row) else len(flat)], begin[a:h] - begin[a], first, lone[first], row[a:e][first])


def _sums(rows: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, by differences of running sums."""
    run = np.concatenate((np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)))
    return run[e] - run[s]


def _feature(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) % np.uint64(FEATURES)).astype(np.int64)


def document_frequencies(coded: DataFrame) -> tuple[np.ndarray, int]:
    """Passages that hold each feature, and the number of passages, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for c in _chunks(b.column(1)):
                f = _feature(c.w)
                block = np.repeat(np.arange(len(c.begin)), np.diff(np.append(c.begin, len(c.w))))
                which = np.full(len(c.begin) + 1, -1)
                which[c.first] = np.arange(len(c.first))
                # a word is in the passage its block begins and in the one of the block before, if that has two
                own, two = which[block], np.full(len(c.begin) + 1, -1)
                two[c.first[~c.lone] + 1] = np.flatnonzero(~c.lone)
                before = two[block]
                key = np.concatenate((own[own >= 0] * FEATURES + f[own >= 0], before[before >= 0] * FEATURES + f[before >= 0]))
                df += np.bincount(np.unique(key) % FEATURES, minlength=FEATURES)
                n += len(c.first)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(df), -1)), pa.array(np.append(df[df > 0], n))], names=["f", "n"])

    got = {r["f"]: r["n"] for r in coded.mapInArrow(run, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect()}
    out = np.zeros(FEATURES)
    for f, n in got.items():
        if f >= 0:
            out[f] = n
    return out, int(got.get(-1, 0))


def _sketch(c: Chunk, weight: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """This chunk's share of A'A * basis, where A holds the TF-IDF passages and table the weighted basis: features and rows."""
    blocks, y = c.sums(table)
    # each block collects the passages that hold it, each word those of its block
    z = np.zeros_like(blocks)
    z[c.first] = y
    z[c.first[~c.lone] + 1] += y[~c.lone]
    f = _feature(c.w)
    block = np.repeat(np.arange(len(c.begin)), np.diff(np.append(c.begin, len(c.w))))
    order = np.argsort(f, kind="stable")
    g = f[order]
    cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    return g[cuts], np.add.reduceat(z[block[order]], cuts, axis=0) * weight[g[cuts], None]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column(0):
            m = np.frombuffer(x.as_py(), np.float64)
            total = m.copy() if total is None else total + m
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["m"])


def latent_space(coded: DataFrame, own: np.ndarray, passages: int, rank: int = RANK, extra: int = EXTRA, seed: int = 5, df: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """An orthonormal basis (features x rank) of the leading latent space.

    ``own`` is the items' share of A'A times the random matrix, of ``passages``
    item passages.  Randomised SVD with one pass over all passages: each partition
    adds its share, shares are summed by a tree whose width follows their number,
    and one matrix of fixed size reaches the driver.  Corpus and item passages
    carry equal weight, so the space holds the items' words however large the corpus.
    """
    spark = coded.sparkSession
    counts, n = df or document_frequencies(coded)
    weight = idf(counts, n)
    omega = random_basis(rank, extra, seed)
    shared = spark.sparkContext.broadcast((weight, omega))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wt, om = shared.value
        table, total = (wt[:, None] * om).astype(np.float32), np.zeros(om.shape)
        for b in batches:
            for c in _chunks(b.column(1)):
                at, share = _sketch(c, wt, table)
                total[at] += share
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["m"])

    width = coded.rdd.getNumPartitions()
    parts = coded.mapInArrow(run, "m binary")
    while True:  # a shuffle each time, so that the first step keeps all its tasks
        width = max(1, -(-width // FAN_IN))
        parts = parts.repartition(width).mapInArrow(_added, "m binary")
        if width == 1:
            break
    parts = parts.collect()
    corpus = np.frombuffer(parts[0]["m"], np.float64).reshape(omega.shape) if parts else np.zeros(omega.shape)
    both = corpus + own * (max(1, n) / max(1, passages))
    q, _ = np.linalg.qr(both)
    u, _, _ = np.linalg.svd(q.T @ both, full_matrices=False)
    return (q @ u)[:, :rank]


def idf(counts: np.ndarray, n: int) -> np.ndarray:
    return np.log((n + 1) / (counts + 1)) + 1.0


def random_basis(rank: int = RANK, extra: int = EXTRA, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((FEATURES, rank + extra))


def item_share(items: Iterable[list[int]], weight: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, int]:
    """The items' part of A'A times a matrix, and their passages."""
    table, out, count = weight[:, None] * omega, np.zeros(omega.shape), 0
    for w in items:
        if len(w):
            f = _feature(np.array(w, np.int64))
            rows = table[f]
            for s in starts(len(w), ITEM_PASSAGE, ITEM_STRIDE):
                e = min(s + ITEM_PASSAGE, len(w))
                np.add.at(out, f[s:e], weight[f[s:e], None] * rows[s:e].sum(axis=0))
                count += 1
    return out, count


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def least_common(n: int) -> int:
    """Common words of a passage of n that make a paraphrase."""
    return next(m for m in range(n + 1) if m / n >= PARAPHRASE)


def best_window(part: list[int], text: list[int], begin: Iterable[int], best: int) -> int:
    """Longest common subsequence of a passage with PASSAGE words of the text from one of the given words, if above ``best``."""
    of = set(part)
    held = list(itertools.accumulate((x in of for x in text), initial=0))
    for a in begin:
        e = min(a + PASSAGE, len(text))
        if held[e] - held[a] > best:
            best = max(best, common_subsequence(part, [x for x in text[a:e] if x in of]))
    return best


def longest_run(a: list[int], b: list[int]) -> int:
    """Length of the longest run of words that both hold."""
    at: dict[int, list[int]] = {}
    for j, y in enumerate(b):
        at.setdefault(y, []).append(j)
    best, before = 0, {}
    for x in a:
        now = {j: before.get(j - 1, 0) + 1 for j in at.get(x, ())}
        if now:
            best = max(best, max(now.values()))
        before = now
    return best


def _contains(haystack: list[int], needle: list[int]) -> bool:
    n = len(needle)
    return bool(n) and any(haystack[i:i + n] == needle for i in range(len(haystack) - n + 1))


def _cells(units: np.ndarray, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """The cell of each unit vector, by spherical k-means with about as many cells as members."""
    k = min(len(units), round(1.5 * len(units) ** 0.5))
    centre = units[np.random.default_rng(seed).choice(len(units), k, replace=False)]
    for _ in range(rounds):
        cell = (units @ centre.T).argmax(axis=1)
        for c in range(k):
            member = units[cell == c].sum(axis=0)
            if member.any():
                centre[c] = member / np.linalg.norm(member)
    return (units @ centre.T).argmax(axis=1)


def common_runs(a: np.ndarray, there: np.ndarray, b: np.ndarray, also: np.ndarray) -> np.ndarray:
    """Which pairs of word windows (rows of a and b, with masks) have RUN consecutive words in common."""
    run = (a[:, :, None] == b[:, None, :]) & there[:, :, None] & also[:, None, :]
    n, have, done = 1, run, None
    # runs of 1, 2, 4, 8 words along the diagonals, put together to RUN
    left = RUN
    while left:
        if left & 1:
            done = have if done is None else done[:, :have.shape[1] - size, :have.shape[2] - size] & have[:, size:, size:]
            size = n if done is have else size + n
        left >>= 1
        if left:
            have = have[:, :-n, :-n] & have[:, n:, n:]
            n *= 2
    return done.any(axis=(1, 2))


class ItemIndex:
    """Item passages in cells of the latent space, with the products a contained run would give."""

    def __init__(self, items: list[tuple[int, list[int], list[int]]], weight: np.ndarray, basis: np.ndarray):
        self.items, self.table = items, (weight[:, None] * basis).astype(np.float32)
        vectors, runs, owner, span = [], [], [], []
        for k, (_, w, _) in enumerate(items):
            if len(w) < RUN:
                continue
            arr = np.array(w, np.int64)
            rows = self.table[_feature(arr)].astype(np.float64)
            for s in starts(len(arr), ITEM_PASSAGE, ITEM_STRIDE):
                e = min(s + ITEM_PASSAGE, len(arr))
                r = np.arange(s, e - RUN + 1)
                vectors.append(rows[s:e].sum(axis=0))
                runs.append(_sums(rows, r, r + RUN))
                owner.append(k)
                span.append((int(s), int(e)))
        vectors = np.array(vectors).reshape(len(owner), basis.shape[1])
        units = vectors / (np.sqrt((vectors**2).sum(axis=1, keepdims=True)) + 1e-30)
        least = np.array([(r @ u).min() for r, u in zip(runs, units)])
        self.owner, self.span = np.array(owner, np.int64), span
        # passages by cell, and for each cell its centre and the least product of a run of its passages with it
        self.cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        centres, floor = [], []
        cell = _cells(units) if len(owner) else np.zeros(0, int)
        for c in np.unique(cell):
            at = np.flatnonzero(cell == c)
            centre = units[at].sum(axis=0)
            centre /= np.linalg.norm(centre) + 1e-30
            centres.append(centre)
            floor.append(CELL_SHARE * min((runs[j] @ centre).min() for j in at))
            self.cells.append((at, units[at].astype(np.float32), (SHARE * least[at]).astype(np.float32)))
        self.centres, self.floor = np.array(centres, np.float32).reshape(len(centres), basis.shape[1]), np.array(floor, np.float32)
        # the words of each passage, for the check of candidates
        self.words, self.there = np.zeros((len(owner), ITEM_PASSAGE), np.int64), np.zeros((len(owner), ITEM_PASSAGE), bool)
        for j, (s, e) in enumerate(span):
            self.words[j, :e - s], self.there[j, :e - s] = items[owner[j]][1][s:e], True
        rare = []
        for j, (s, e) in enumerate(span):
            part = items[owner[j]][1][s:e]
            part = [part[i] for i in np.argsort(-weight[_feature(np.array(part, np.int64))], kind="stable")]
            rare += [(c, j) for c in set(part[:len(part) - least_common(len(part)) + SURE])]
        rare.sort()
        self.rare, self.rare_owner = np.array([c for c, _ in rare], np.int64), np.array([j for _, j in rare], np.int64)

    def candidates(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Passages of the chunk and item passages whose cosine is at least that of a contained run."""
        _, v = c.sums(self.table)
        probe = v @ self.centres.T >= self.floor
        at, which = [], []
        for k, (members, units, least) in enumerate(self.cells):
            rows = np.flatnonzero(probe[:, k])
            if len(rows):
                hit = np.flatnonzero(v[rows] @ units.T >= least)
                at.append(rows[hit // len(members)])
                which.append(members[hit % len(members)])
        return (np.concatenate(at), np.concatenate(which)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def confirmed(self, c: Chunk, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Which candidates have a run of words in common, by comparing the words."""
        out = np.zeros(len(at), bool)
        for a in range(0, len(at), CHECKED):
            doc, there = c.windows(at[a:a + CHECKED])
            item = which[a:a + CHECKED]
            out[a:a + CHECKED] = common_runs(doc, there, self.words[item], self.there[item])
        return out

    def near(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """Row, item passage, and first and last word of each stretch of SURE of its rare words within PASSAGE words of that row."""
        flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
        rows = np.repeat(np.arange(len(column)), np.diff(offsets))
        for a in range(0, len(flat), CHUNK):
            # any PASSAGE words lie inside one piece
            w, row = flat[a:a + CHUNK + PASSAGE - 1], rows[a:a + CHUNK + PASSAGE - 1]
            lo, hi = np.searchsorted(self.rare, w, "left"), np.searchsorted(self.rare, w, "right")
            n = hi - lo
            pos = np.repeat(np.arange(len(w)), n)
            which = self.rare_owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(pos))]
            order = np.argsort(which, kind="stable")
            which, pos = which[order], pos[order]
            x, y = pos[:len(pos) - SURE + 1], pos[SURE - 1:]
            at = np.flatnonzero((which[:len(x)] == which[SURE - 1:]) & (y - x < PASSAGE) & (row[x] == row[y])) if len(y) else np.zeros(0, np.int64)
            first = offsets[row[x[at]]] - a
            yield from zip(row[x[at]].tolist(), which[at].tolist(), (x[at] - first).tolist(), (y[at] - first).tolist())


def leaks(docs: DataFrame, items: DataFrame, *, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", answer: str = "answer", paraphrases: bool = True) -> DataFrame:
    """``doc_id, item_id, run, shared, kind``: documents that hold passages of items.

    ``run`` is the longest run of common words, ``shared`` the greatest share of
    an item passage that is a common subsequence with any 24 consecutive words of
    the document.  kind is ``verbatim`` for a run of 12 words or more; else
    ``paraphrase`` where ``shared`` is 0.8 or more and the item's answer, if it
    has one, stands in the document.  Without ``paraphrases`` only verbatim rows
    come out, and ``shared`` is NULL.  Null and empty texts hold nothing; items of
    fewer than 12 words are never found; a repeated document gives its rows again;
    a repeated item_id counts once, with its smallest text; empty tables give no
    rows.  Whole texts are searched.  No shuffle follows the word coding.
    """
    spark = docs.sparkSession
    coded = cut(word_codes(docs, ident, text), "words")
    chosen = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).groupBy(F.col(item).cast("bigint").alias("item")).agg(F.min(F.struct(F.col(item_text).alias("t"), F.col(answer).alias("a"))).alias("s"))
    blocks = max(1, -(-chosen.count() // ITEM_BLOCK))

    def block(n: int) -> list[tuple[int, list[int], list[int]]]:
        rows = chosen.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == n).orderBy("item").collect()
        return [(r["item"], _codes(words(r["s"]["t"])), _codes(words(r["s"]["a"]))) for r in rows]

    df = document_frequencies(coded)
    weight, omega, own, count = idf(*df), random_basis(), 0.0, 0
    for n in range(blocks):
        part, k = item_share([w for _, w, _ in block(n)], weight, omega)
        own, count = own + part, count + k
    basis = latent_space(coded, own, count, df=df)
    out: DataFrame | None = None
    for n in range(blocks):
        found = _search(coded, spark.sparkContext.broadcast((block(n), weight, basis)), paraphrases)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", ident).withColumnRenamed("item", item)


_WORKER: dict[int, ItemIndex] = {}


def _search(coded: DataFrame, shared, paraphrases: bool) -> DataFrame:
    key = int.from_bytes(hashlib.blake2b(repr(shared.value[0]).encode() + shared.value[2].tobytes(), digest_size=8).digest(), "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = ItemIndex(*shared.value)
        index = _WORKER[key]
        if not len(index.owner):
            return
        for b in batches:
            verbatim: set[tuple[int, int]] = set()
            share: dict[tuple[int, int], float] = {}
            for c in _chunks(b.column(1)):
                at, which = index.candidates(c)
                ok = index.confirmed(c, at, which)
                verbatim.update(zip(c.row[at[ok]].tolist(), index.owner[which[ok]].tolist()))
            rows: dict[int, list[int]] = {}
            if paraphrases:
                for r, j, x, y in index.near(b.column(1)):
                    if r not in rows:
                        rows[r] = b.column(1)[r].as_py()
                    k, (lo, hi) = (r, int(index.owner[j])), index.span[j]
                    part, end = index.items[k[1]][1][lo:hi], max(0, len(rows[r]) - PASSAGE)
                    lo, hi = max(0, min(y - PASSAGE + 1, end)), min(x, end)
                    most = max(least_common(len(part)) - 1, round(share.get(k, 0.0) * len(part)))
                    n = best_window(part, rows[r][lo:hi + PASSAGE], range(hi - lo + 1), most)
                    if n > most:
                        share[k] = max(share.get(k, 0.0), n / len(part))
            ids, got = b.column(0).to_pylist(), []
            for r, k in sorted(verbatim | share.keys()):
                name, ws, ans = index.items[k]
                whole = rows.get(r)
                if whole is None:
                    whole = rows[r] = b.column(1)[r].as_py()
                x, n = share.get((r, k), 0.0), longest_run(whole, ws)
                if n >= RUN:
                    if paraphrases:
                        for j in range(*np.searchsorted(index.owner, (k, k + 1)).tolist()):
                            lo, hi = index.span[j]
                            x = max(x, best_window(ws[lo:hi], whole, range(max(1, len(whole) - PASSAGE + 1)), round(x * (hi - lo))) / (hi - lo))
                    got.append((ids[r], name, n, x if paraphrases else None, "verbatim"))
                elif x >= PARAPHRASE and (not ans or _contains(whole, ans)):
                    got.append((ids[r], name, n, x, "paraphrase"))
            if got:
                cols = list(zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.string())], names=["id", "item", "run", "shared", "kind"])

    return coded.mapInArrow(run, "id bigint, item bigint, run int, shared double, kind string")
