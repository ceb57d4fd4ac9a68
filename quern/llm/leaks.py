"""Problem 9: evaluation texts that leaked into documents.

Every document is scanned once with an automaton of the items' character n-grams. An n-gram
is a rare seed if it holds a word that is rare in the corpus, or if the documents that have it
tend to have much of its item, too; so stock phrases are none, and an item that leaked into
very many documents keeps its seeds.
Documents joined to an item by rare seeds are scored by repeated Smith-Waterman alignment
over words, where missing a rare word costs more; the share of the item that the alignments
cover tells a leak. Spacing, punctuation, case, character forms and the order of
passages make no difference.

Results for odd input: null and empty texts hold nothing; items without a letter or digit
leak nowhere; repeated rows are reported once; empty tables give none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import lookalike
from quern.session import durable

#: Every task holds the items of one block, about so many characters; more items are taken in more blocks, each of which scans the documents.
BLOCK_CHARS = 5_000_000
#: Up to so many documents with candidates (some 30 bytes each) are broadcast to the second scan; beyond, they are joined by a shuffle.
MAX_BROADCAST_DOCUMENTS = 1_000_000
SLICE = 1024  # documents that are cut into words at once
SEED, STRIDE = 14, 7  # characters of a seed, without spaces and punctuation, and steps between seeds
SEED_WIDE, STRIDE_WIDE = 7, 3  # the same in scripts of wide characters
RARE_WORD = 0.03  # a word is rare if no more than this share of the documents with the item's most frequent word have it,
RARE_MEAN = 0.6  # or if the documents with the n-grams around it have this share of the item on average
SEED_SHARE = 0.10  # of an item's seeds, rare ones only, that make a candidate;
LEAST_RARE, RARE_SHARE = 3, 0.3  # or so many rare ones that are this share of the item's rare seeds, for items of many stock phrases
HELD = 0.42  # share of an item's text that a document must hold ("about half")
LEAST_SCORE = 8.0  # of an alignment that counts
MATCH, RARE_MATCH, MISS, RARE_MISS, GAP = 1.0, 2.0, -1.5, -2.5, -1.5

_WORDS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}]|\p{Nd}+|(?:(?![\p{Nd}\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])[\p{L}\p{M}\p{N}])+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")
_ODD = re.compile(f"[{lookalike.ZERO_WIDTH}{lookalike.JOINERS}\u0370-\u04FF\u0C00-\u0C7F\u3000\uFF00-\uFFEF]")
GAPS, ALONE = r"[^\pL\pM\pN]+", r"([\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}])"
FIRST = r"(?s)^.*?(?:[.!?।॥。؟۔:]|\n)\s*"
_DIGIT = re.compile(r"[٠-٩۰-۹०-९౦-౯೦-೯๐-๙]+")


def fold(text: str) -> str:
    """One form for comparison: composed, lower case, look-alikes respelt, digits as ASCII."""
    if text.isascii():
        return text.lower()
    if _ODD.search(text):
        text = lookalike._JOIN.sub("", lookalike.unify(text) or "")
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _DIGIT.sub(lambda m: "".join(str(unicodedata.digit(c)) for c in m.group()), text.lower())


def words(folded: str) -> list[str]:
    return _WORDS.findall(folded)


def spaced(texts: list[str]) -> pa.Array:
    """The folded texts as words with spaces between; a character of a script without spaces is a word."""
    plain = pc.replace_substring_regex(pa.array([fold(t) for t in texts], pa.large_string()), GAPS, " ")
    return pc.replace_substring_regex(plain, ALONE, r" \1 ")


def own_texts(items: DataFrame) -> DataFrame:
    """Rows (item_id, text): one text an item, without an opening sentence that more than two items share."""
    one = items.where("item_id IS NOT NULL AND length(text) > 0").groupBy("item_id").agg(F.max("text").alias("text"))
    one = one.withColumn("head", F.regexp_extract("text", FIRST, 0))
    same = F.count(F.lit(1)).over(Window.partitionBy(F.trim("head")))
    shared = (same > 2) & (F.length("head") > 0) & (F.length("head") < 0.6 * F.length("text"))
    return one.select(F.col("item_id").cast("bigint").alias("item_id"), F.when(shared, F.expr("substring(text, length(head) + 1)")).otherwise(F.col("text")).alias("text"))


class Items:
    """A block of the evaluation items, their seeds and the automaton that finds these.

    A slot is a place of a seed in an item; a seed that several items have, has several slots.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        self.tokens = {k: toks for k, t in rows if (toks := words(fold(t)))}
        self.keys = list(self.tokens)
        self.size = {k: sum(map(len, toks)) for k, toks in self.tokens.items()}
        self.places: dict[int, list[int]] = {}  # where the item's seeds start
        self.length: dict[int, int] = {}
        self.base: dict[int, int] = {}  # the item's first slot
        where: dict[str, list[int]] = {}
        owner: list[int] = []
        for number, (k, toks) in enumerate(self.tokens.items()):
            joined = "".join(toks)
            wide = 2 * len(_WIDE.findall(joined)) > len(joined)
            n, step = (SEED_WIDE, STRIDE_WIDE) if wide else (SEED, STRIDE)
            n = min(n, len(joined))
            self.length[k], self.base[k] = n, len(owner)
            self.places[k] = sorted({*range(0, len(joined) - n + 1, step), len(joined) - n})
            for at in self.places[k]:
                where.setdefault(joined[at : at + n], []).append(len(owner))
                owner.append(number)
        self.seeds = list(where)
        self.slots = [np.array(v) for v in where.values()]
        self.owner = np.array(owner, int)
        self.n_places = np.array([len(self.places[k]) for k in self.keys], float)
        self.vocabulary = sorted({w for toks in self.tokens.values() for w in toks})
        self.rare: dict[int, list[bool]] = {}
        self.rare_slot = np.zeros(len(owner), bool)
        self.n_rare = np.zeros(len(self.keys), int)
        self._automaton: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def found(self, text: str) -> list[int]:
        """The numbers of the seeds that a spaced text has."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for i, s in enumerate(self.seeds):
                self._automaton.add_word(s, i)
            if self.seeds:
                self._automaton.make_automaton()
        return list({i for _, i in self._automaton.iter(text.replace(" ", ""))}) if self.seeds else []

    def counted(self, seeds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The slots of seeds and, per item, how many of them are its."""
        slots = np.concatenate([self.slots[i] for i in seeds])
        return slots, np.bincount(self.owner[slots], minlength=len(self.keys))

    def candidates(self, seeds: list[int]) -> np.ndarray:
        """The items that a document with these seeds is aligned with."""
        slots, _ = self.counted(seeds)
        n = np.bincount(self.owner[slots[self.rare_slot[slots]]], minlength=len(self.keys))
        return np.flatnonzero((n >= SEED_SHARE * self.n_places) | ((n >= LEAST_RARE) & (n >= RARE_SHARE * self.n_rare)))

    def documents_with(self, texts: pa.Array) -> np.ndarray:
        """Of each word of the vocabulary, how many of the spaced texts have it."""
        lists, n = pc.utf8_split_whitespace(texts), len(self.vocabulary)
        word = pc.index_in(pc.list_flatten(lists), value_set=pa.array(self.vocabulary, pa.large_string()))
        known = pc.is_valid(word)
        at, doc = word.filter(known).to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).filter(known).to_numpy(zero_copy_only=False)
        return np.bincount(np.unique(doc.astype(np.int64) * n + at) % n, minlength=n) if n else np.zeros(0, np.int64)

    def learn(self, documents: np.ndarray, with_seed: np.ndarray, total: np.ndarray) -> None:
        """Rare words and seeds, from the documents per word and per slot and the sum of these documents' shares per slot."""
        having = dict(zip(self.vocabulary, documents.tolist()))
        telling = (with_seed > 0) & (total >= RARE_MEAN * with_seed)
        for k, toks in self.tokens.items():
            most = max(having[w] for w in toks)
            at, flags, base = 0, [], self.base[k]
            for w in toks:
                over = [i for i, p in enumerate(self.places[k]) if p < at + len(w) and at < p + self.length[k]]
                rare = having[w] <= RARE_WORD * most and len(w) > 1
                flags.append(rare or bool(over) and all(telling[base + i] for i in over))
                if flags[-1]:
                    least = min(len(w), 4)
                    for i in over:
                        if min(self.places[k][i] + self.length[k], at + len(w)) - max(self.places[k][i], at) >= least:
                            self.rare_slot[base + i] = True
                at += len(w)
            self.rare[k] = flags
        self.n_rare = np.bincount(self.owner[self.rare_slot], minlength=len(self.keys))

    def held(self, k: int, doc: list[str], spots: list[int]) -> float:
        """The share of item ``k``'s characters covered by alignments with the document near ``spots`` (word numbers)."""
        item, near = self.tokens[k], len(self.tokens[k]) + 8
        spans: list[list[int]] = []
        for i in spots:
            if spans and i - near <= spans[-1][1]:
                spans[-1][1] = i + near
            else:
                spans.append([max(0, i - near), i + near])
        number = {w: n for n, w in enumerate(dict.fromkeys(item))}
        ids, covered = np.array([number[w] for w in item]), np.zeros(len(item), bool)
        rare = np.array(self.rare[k])
        for lo, hi in spans:
            for part in range(lo, min(hi, len(doc)), 3 * near):
                window = np.array([number.get(w, -1) for w in doc[part : min(part + 5 * near, hi)]])
                self._align(ids, rare, window, covered)
        return sum(len(w) for w, c in zip(item, covered) if c) / self.size[k]

    @staticmethod
    def _align(ids: np.ndarray, rare: np.ndarray, doc: np.ndarray, covered: np.ndarray) -> None:
        """Marks what the best local alignments of the item's open words with ``doc`` cover, one after the other while they count."""
        m = len(doc)
        slope = GAP * np.arange(m + 1)
        while not covered.all():
            grid = np.zeros((len(ids) + 1, m + 1))
            for i, word in enumerate(ids):
                if covered[i]:
                    continue  # an alignment can't pass what is used up
                gain = np.where(doc == word, RARE_MATCH if rare[i] else MATCH, RARE_MISS if rare[i] else MISS)
                row = np.zeros(m + 1)
                row[1:] = np.maximum(grid[i, :-1] + gain, grid[i, 1:] + GAP)
                grid[i + 1] = np.maximum(np.maximum.accumulate(row - slope) + slope, 0)
            i, j = divmod(int(grid.argmax()), m + 1)
            if grid[i, j] < LEAST_SCORE:
                return
            hit = []
            while i > 0 and j > 0 and grid[i, j] > 0:
                if doc[j - 1] == ids[i - 1]:
                    good = RARE_MATCH if rare[i - 1] else MATCH
                else:
                    good = RARE_MISS if rare[i - 1] else MISS
                if abs(grid[i, j] - grid[i - 1, j - 1] - good) < 1e-9:
                    if doc[j - 1] == ids[i - 1]:
                        hit.append(i - 1)
                    i, j = i - 1, j - 1
                elif abs(grid[i, j] - grid[i - 1, j] - GAP) < 1e-9:
                    i -= 1
                else:
                    j -= 1
            span = slice(min(hit), max(hit) + 1)
            if 2 * rare[hit].sum() < max(rare[span].sum(), 1):
                return  # a stock phrase
            covered[span] = True  # a few exchanged words within are held, too


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, held): the documents that hold about half of an item's text or more.

    ``items`` is a fixed set of evaluation texts; it is taken in blocks of BLOCK_CHARS, each broadcast and scanned
    for on its own. Blocks don't change the result: what an item needs to know of others is found before.
    """
    docs = documents.where(F.length(text) > 0).select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    own = own_texts(items)
    blocks = max(1, -(-(own.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    out = None
    for block in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        one = _leaks(docs, Items([(r.item_id, r.text) for r in rows]))
        out = one if out is None else out.unionByName(one)
    return out


def _leaks(docs: DataFrame, them: Items) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(them)
    schema = pa.schema([("doc", pa.int64()), ("seeds", pa.list_(pa.int32())), ("slot", pa.int32()), ("word", pa.int32()), ("n", pa.int64()), ("total", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        with_seed, total, having = np.zeros(len(known.owner), np.int64), np.zeros(len(known.owner)), np.zeros(len(known.vocabulary), np.int64)
        rows = lambda **c: pa.RecordBatch.from_pydict({f.name: pa.array(c.get(f.name, [None] * len(next(iter(c.values())))), f.type) for f in schema}, schema)
        for b in batches:
            ids, seeds = [], []
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                texts = spaced(part.column("text").to_pylist())
                having += known.documents_with(texts)
                for d, t in zip(part.column("doc").to_pylist(), texts.to_pylist()):
                    if got := known.found(t):
                        slots, n = known.counted(got)
                        with_seed[slots] += 1
                        total[slots] += (n / known.n_places)[known.owner[slots]]
                        if ((n >= SEED_SHARE * known.n_places) | (n >= LEAST_RARE)).any():
                            ids.append(d)
                            seeds.append(got)
            yield rows(doc=ids, seeds=seeds)
        some, any_ = np.flatnonzero(with_seed), np.flatnonzero(having)
        yield rows(slot=some, n=with_seed[some], total=total[some])
        yield rows(word=any_, n=having[any_])

    found = durable(docs.mapInArrow(scan, "doc bigint, seeds array<int>, slot int, word int, n bigint, total double"))
    stats = found.where("n IS NOT NULL").groupBy("slot", "word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas()  # bounded by the items
    documents, with_seed, total = np.zeros(len(them.vocabulary), np.int64), np.zeros(len(them.owner), np.int64), np.zeros(len(them.owner))
    of_word, of_slot = stats[stats.word.notna()], stats[stats.slot.notna()]
    documents[of_word.word.astype(int)] = of_word.n
    with_seed[of_slot.slot.astype(int)], total[of_slot.slot.astype(int)] = of_slot.n, of_slot.total
    them.learn(documents, with_seed, total)
    learnt = spark.sparkContext.broadcast(them)

    def candidates(seeds: pd.Series) -> pd.Series:
        return seeds.map(learnt.value.candidates)

    pairs = found.where("doc IS NOT NULL").select("doc", F.pandas_udf(candidates, "array<int>")("seeds").alias("items")).where(F.size("items") > 0)
    per_doc = durable(pairs.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")))  # at most all items

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = learnt.value
        names = {k: {w for w, r in zip(known.tokens[k], known.rare[k]) if r} for k in known.keys}
        for b in batches:
            out = []
            for d, t, ks in zip(b.doc, b.text, b["items"]):
                doc = words(fold(t))
                for k in (known.keys[i] for i in ks):
                    h = known.held(k, doc, [i for i, w in enumerate(doc) if w in names[k]])
                    if h >= HELD:
                        out.append((d, k, h))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "held"])

    few = per_doc.count() <= MAX_BROADCAST_DOCUMENTS
    scored = docs.join(F.broadcast(per_doc) if few else per_doc, "doc").select("doc", "text", "items").mapInPandas(score, "doc_id bigint, item_id bigint, held double")
    return scored.groupBy("doc_id", "item_id").agg(F.max("held").alias("held"))


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (item_id, n_documents, most_held) of the items that leaked."""
    return leaks(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("held").alias("most_held"))
