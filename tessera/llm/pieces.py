"""SentencePiece encoding and decoding (operator 6): a relational lattice of pieces over words, folded in rank order.

A word is a longest stretch of characters any two neighbours of which stand side by side in some piece.  No piece, and
so no merge, crosses a word's border, and equal words have equal ids wherever they stand.

1. A pass over all documents counts their words.
2. The most frequent words, at most `FREQUENT` of them, are encoded by the relational lattice: explode the substrings of
   bounded length, equi-join them with the piece table, group the edges by word, fold them with `aggregate`.
3. Their ids are broadcast, and each document is put together from its words' ids.  A word that isn't in the table (rare,
   or of more than `MASKED` characters) goes through the same three steps in the task that meets it, as array operations:
   given back through a join, rare words would have to be shuffled with all their documents, and the documents too, since
   nearly each holds some.  Which way a word goes changes no id.

The fold depends on the model.  A unigram model's piece scores are log-probabilities and the fold is Viterbi's.  The
given public model is byte-pair encoded: its scores are merge ranks, and the sum of ranks along a path is not what the
model maximises, so there the fold takes edges in rank order and applies each that joins exactly two pieces.  (One
pass is enough because every piece of such a model is built from pieces of lower rank.)  Characters without a piece
become their bytes.

Defined results: a null or empty text has no ids; U+2581 counts as a space, as the format has it, so such a text comes
back with spaces; repeated rows get equal ids; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.store import kept

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Longest word whose borders fit a 64-bit mask, in characters.
MASKED = 62
#: Words of the broadcast table, at most; with MASKED characters each that bounds its size (typically 10 MB).
FREQUENT = 1 << 18
#: Tasks of the lattice: words are few bytes, their substrings many rows, so Spark would give them too few tasks by size.
TASKS = 32
#: Text that a task takes at a time.
SLICE = 2 << 20
_U1 = np.uint64(1)


class Pieces:
    """The piece table: bytes (a space for U+2581), id and rank (0: merged first) of every piece that texts can hold."""

    def __init__(self, model: str = MODEL) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        self.rows, self.all, self.byte = [], [], {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.all.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i):
                self.all.append(b"")
            else:
                self.rows.append((piece.replace("▁", " "), i, lib.get_score(i)))
                self.all.append(piece.replace("▁", " ").encode())
        self._index()

    def _index(self) -> None:
        """Arrays for look-ups by hash, and which characters stand side by side in some piece."""
        ranked = sorted(self.rows, key=lambda r: (-r[2], r[1]))
        w = T.words(pa.array([r[0] for r in ranked], pa.large_string()), np.ones(256, bool))
        order = np.argsort(w.hash)
        self.hash, self.rank = w.hash[order], order
        self.id = np.array([r[1] for r in ranked], np.int64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.hash & np.uint64((1 << 22) - 1)] = True
        self.lengths = np.array([len(x) for x in self.all], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.all), np.uint8)
        self.longest = max((len(r[0]) for r in ranked), default=1)
        chars = sorted({c for r in ranked if len(r[0]) > 1 for c in r[0]})
        number = {c: i for i, c in enumerate(chars, 1)}
        self.char = np.zeros(0x110000, np.uint16)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for r in ranked:
            for x, y in zip(r[0], r[0][1:]):
                self.beside[number[x], number[y]] = True
        self.byte_id = np.array([self.byte.get(b, 0) for b in range(256)], np.int64)

    def ranks(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are pieces, and their ranks."""
        at = np.flatnonzero(self.maybe[h & np.uint64((1 << 22) - 1)])
        to = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        hit = self.hash[to] == h[at]
        return at[hit], self.rank[to[hit]]


def _prepared(texts: pa.Array) -> pa.Array:
    """Texts with spaces for U+2581 and a leading space, as the format adds; empty ones stay empty."""
    texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "▁", " ")
    return pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))


class WordTable:
    """Ids of words that are known beforehand, by two independent hashes of their bytes."""

    def __init__(self, words: list[str] = (), ids: list[list[int]] = ()) -> None:
        w = T.words(pa.array(list(words), pa.large_string()), np.ones(256, bool))
        order = np.argsort(w.hash, kind="stable")
        h = w.hash[order]
        alone = np.ones(len(h), bool)
        alone[1:] &= h[1:] != h[:-1]
        alone[:-1] &= h[1:] != h[:-1]
        order = order[alone]
        self.key, self.other = w.hash[order], w.other()[order]
        size = np.array([len(ids[i]) for i in order], np.int64)
        self.size, self.begin = size, np.cumsum(size) - size
        self.ids = np.array([x for i in order for x in ids[i]], np.int32)

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Each word's place in the table, or -1."""
        if not len(self.key):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        return np.where((self.key[at] == h) & (self.other[at] == g), at, -1)


class _Words:
    """The distinct words of a slice of texts, and which of them each place holds."""

    def __init__(self, texts: pa.Array, pieces: Pieces) -> None:
        self.data, offsets = T.buffers(_prepared(texts))
        n = len(self.data)
        lead = np.flatnonzero((self.data & 0xC0) != 0x80)
        size = np.diff(np.append(lead, n))
        code = self.data[lead].astype(np.int64)
        for k in range(1, 4):
            some = np.flatnonzero(size > k)
            if k == 1:
                code[some] &= np.array([0, 0, 0x1F, 0x0F, 0x07])[np.minimum(size[some], 4)]
            code[some] = code[some] << 6 | self.data[lead[some] + k] & 0x3F
        kind = pieces.char[np.minimum(code, 0x10FFFF)]
        first = np.ones(len(lead), bool)
        first[1:] = ~pieces.beside[kind[:-1], kind[1:]]
        first[np.searchsorted(lead, offsets[:-1][offsets[:-1] < n])] = True
        start = lead[first]
        end = np.append(start[1:], n)[: len(start)]
        h, g = T.hashed(self.data, start, end), T.hashed(self.data, start, end, 1)
        _, one, self.word = np.unique(h, return_index=True, return_inverse=True)
        if (g[one][self.word] != g).any():
            _, one, self.word = np.unique(np.column_stack([h, g]), axis=0, return_index=True, return_inverse=True)
        self.start, self.end, self.hash, self.other = start[one], end[one], h[one], g[one]
        self.row_words = np.searchsorted(start, offsets)


class _Lattice:
    """Ids of words that are stretches of `data`: lattice and fold as array operations."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Pieces) -> None:
        self.pieces, self.data, self.start, self.end = pieces, data, start, end
        self.chars()
        self.fold()
        self.spell()

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return T.hashed(self.data, start, end)

    def chars(self) -> None:
        """Byte positions of the distinct words' characters, word after word."""
        size = self.end - self.start
        at = np.repeat(self.start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        lead = (self.data[at] & 0xC0) != 0x80
        self.char = at[lead]
        of = np.repeat(np.arange(len(size)), size)[lead]
        self.n_chars = np.bincount(of, minlength=len(size))
        self.first = np.cumsum(self.n_chars) - self.n_chars
        self.of = of
        self.place = np.arange(len(of)) - self.first[of]
        self.char_end = np.append(self.char[1:], 0)
        last = self.first + self.n_chars - 1
        self.char_end[last] = self.end

    def edges(self) -> tuple[np.ndarray, ...]:
        """(word, rank, from, characters) of all substrings that are pieces, in that order."""
        found = []
        left = self.n_chars[self.of] - self.place
        for size in range(2, self.pieces.longest + 1):
            at = np.flatnonzero(left >= size)
            if not len(at):
                break
            hit, rank = self.pieces.ranks(self.hashes(self.char[at], self.char_end[at + size - 1]))
            found.append((self.of[at[hit]], rank, self.place[at[hit]], np.full(len(hit), size)))
        word, rank, place, size = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        order = np.argsort(word << 36 | rank << 20 | np.minimum(place, (1 << 20) - 1), kind="stable")
        return word[order], rank[order], place[order], size[order]

    def fold(self) -> None:
        """Marks where the final pieces start."""
        word, _, place, size = self.edges()
        border = np.ones(len(self.of), bool)
        n = np.bincount(word, minlength=len(self.start))
        begin = np.cumsum(n) - n
        short = self.n_chars <= MASKED
        mask = np.where(short, (_U1 << np.minimum(self.n_chars + 1, 63).astype(np.uint64)) - _U1, np.uint64(0))
        by_size = np.argsort(-np.where(short, n, 0), kind="stable")
        steps = n[by_size] * short[by_size]
        a, k = place.astype(np.uint64), size.astype(np.uint64)
        for step in range(int(steps.max(initial=0))):
            words = by_size[: np.searchsorted(-steps, -step)]
            e = begin[words] + step
            m, low, wide = mask[words], a[e], k[e]
            inside = (m >> (low + _U1)) & ((_U1 << (wide - _U1)) - _U1)
            ok = ((m >> low) & (m >> (low + wide)) & _U1).astype(bool) & (inside != 0) & (inside & (inside - _U1) == 0)
            mask[words[ok]] = m[ok] & ~(inside[ok] << (low[ok] + _U1))
        fits = short[self.of]
        border[fits] = ((mask[self.of[fits]] >> self.place[fits].astype(np.uint64)) & _U1).astype(bool)
        for w in np.flatnonzero(~short).tolist():
            held = bytearray(b"\1") * (int(self.n_chars[w]) + 1)
            for e in range(begin[w], begin[w] + n[w]):
                i, j = int(place[e]), int(place[e] + size[e])
                if held[i] and held[j] and sum(held[i + 1 : j]) == 1:
                    held[held.index(1, i + 1)] = 0
            border[self.first[w] : self.first[w] + self.n_chars[w]] = np.frombuffer(held, np.uint8)[:-1].astype(bool)
        self.token = np.flatnonzero(border)

    def spell(self) -> None:
        """Ids of the words, one after another, and how many each has."""
        start = self.char[self.token]
        stop = np.append(self.token[1:], len(self.of))[: len(self.token)] - 1
        end = self.char_end[stop]
        hit, rank = self.pieces.ranks(self.hashes(start, end))
        ids = np.full(len(start), -1, np.int64)
        ids[hit] = self.pieces.id[rank]
        spread = np.where(ids < 0, end - start, 1)
        flat = np.repeat(ids, spread)
        at = np.repeat(start, spread) + np.arange(len(flat)) - np.repeat(np.cumsum(spread) - spread, spread)
        flat[flat < 0] = self.pieces.byte_id[self.data[at[flat < 0]]]
        self.ids, self.size = flat.astype(np.int32), np.bincount(self.of[self.token], spread, len(self.start)).astype(np.int64)


def encode_batch(texts: pa.Array, pieces: Pieces, table: WordTable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and len(texts) + 1 offsets."""
    table = table or WordTable()
    w = _Words(texts, pieces)
    at = table.find(w.hash, w.other)
    new = np.flatnonzero(at < 0)
    more = _Lattice(w.data, w.start[new], w.end[new], pieces)
    size, begin = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    known = at >= 0
    size[known], begin[known] = table.size[at[known]], table.begin[at[known]]
    size[new], begin[new] = more.size, len(table.ids) + np.cumsum(more.size) - more.size
    ids = np.concatenate([table.ids, more.ids])
    n = size[w.word]
    ends = np.cumsum(n)
    out = ids[np.repeat(begin[w.word] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    return out, np.concatenate([[0], ends])[w.row_words]


def decode_batch(ids: np.ndarray, bounds: np.ndarray, pieces: Pieces) -> list[bytes]:
    """UTF-8 of each row's ids, without the leading space that encoding added."""
    size = pieces.lengths[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = pieces.bytes[np.repeat(pieces.offsets[ids], size) + np.arange(ends[-1]) - np.repeat(ends[:-1], size)].tobytes()
    cut = ends[bounds].tolist()
    return [flat[a + (flat[a : a + 1] == b" ") : b] for a, b in zip(cut[:-1], cut[1:])]


def vocabulary(documents: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, n): every word of the texts, with the number of its places (in slices of text, equal words count as one
    row on their way)."""
    shared = documents.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                w = _Words(part.column("text"), shared.value)
                raw, size = w.data, w.end - w.start
                cut = np.concatenate([[0], np.cumsum(size)])
                flat = raw[np.repeat(w.start - cut[:-1], size) + np.arange(cut[-1])]
                words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(flat.tobytes())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(w.word, minlength=len(size)).astype(np.int64))], ["word", "n"])

    return documents.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(words: DataFrame, most: int = FREQUENT) -> DataFrame:
    """(word): the most frequent of (word, n) rows, at most `most`; words of nearly one frequency come or stay together."""
    grade = F.floor(16 * F.log2("n")).cast("int")
    sizes = sorted(((r.grade, r["count"]) for r in words.groupBy(grade.alias("grade")).count().collect()), reverse=True)
    total, least = 0, None
    for k, n in sizes:
        total += n
        if total > most:
            break
        least = k
    return words.where(grade >= F.lit(least)).select("word") if least is not None else words.limit(0).select("word")


def word_table(documents: DataFrame, pieces: Pieces, most: int = FREQUENT) -> WordTable:
    """Ids of the documents' most frequent words, by the relational lattice."""
    spark = documents.sparkSession
    words = kept(vocabulary(documents, pieces).where(F.length("word") <= MASKED), "words")
    rows = encode_words(frequent_words(words, most), piece_table(spark, pieces), pieces).toArrow()
    return WordTable(rows.column("word").to_pylist(), rows.column("ids").to_pylist())


def _encoder(documents: DataFrame, model: str, most: int):
    """Piece table and word table, broadcast; the model's file and `most` bound their size."""
    pieces = Pieces(model)
    return documents.sparkSession.sparkContext.broadcast((pieces, word_table(documents, pieces, most)))


def encode(documents: DataFrame, model: str = MODEL, most: int = FREQUENT) -> DataFrame:
    """doc_id and ids of every row."""
    shared = _encoder(documents, model, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                ids, bounds = encode_batch(part.column("text"), *shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), T.lists(ids, bounds, pa.int32())], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows with ids (null ids: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            bounds = np.cumsum([0, *(len(x or ()) for x in lists)])
            ids = np.array([i for x in lists for i in x or ()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode(errors="replace") for t in decode_batch(ids, bounds, shared.value)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(documents: DataFrame, model: str = MODEL, most: int = FREQUENT) -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids (32-bit, little-endian) and of the text decoded from them, and whether
    it equals the text."""
    shared = _encoder(documents, model, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                ids, bounds = encode_batch(part.column("text"), *shared.value)
                texts = decode_batch(ids, bounds, shared.value[0])
                raw, cut = ids.astype("<i4").tobytes(), (4 * bounds).tolist()
                data, offsets = T.buffers(part.column("text"))
                given, at = data.tobytes(), offsets.tolist()
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut, cut[1:])], pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([t == given[a:b] for t, a, b in zip(texts, at, at[1:])], pa.bool_()),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, id, score, rank) rows."""
    ranked = sorted(pieces.rows, key=lambda r: (-r[2], r[1]))
    return spark.createDataFrame([(p, i, float(s), k) for k, (p, i, s) in enumerate(ranked)], "piece string, id int, score double, rank int")


def lattice(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """word and edges (rank, from, chars, id, score) of (word) rows of up to MASKED characters.  The words' partitioning
    carries through, so grouping back needs no second shuffle."""
    cut = (
        words.select("word").repartition(TASKS, "word")
        .select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("from"))
        .select("word", "from", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("from")))).alias("chars"))
        .withColumn("piece", F.expr("substring(word, from + 1, chars)"))
    )
    # Single characters stay without a piece too, so that no word is lost.
    edges = cut.join(F.broadcast(table), "piece", "left").where("id IS NOT NULL OR chars = 1")
    edge = F.when(F.col("id").isNotNull(), F.struct("rank", "from", "chars", "id", "score"))
    return edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def fold_merges(edges: str = "edges", word: str = "word") -> F.Column:
    """Mask of the borders of a word's pieces in a byte-pair model: bit k is set where a piece starts or the word ends."""
    start = F.expr(f"shiftleft(1L, length({word}) + 1) - 1")

    def merge(mask: F.Column, e: F.Column) -> F.Column:
        low, size = e["from"].cast("int"), e["chars"].cast("int")
        inside = F.call_function("shiftright", mask, low + 1).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), size - 1) - 1)
        ends = F.call_function("shiftright", mask, low).bitwiseAND(F.call_function("shiftright", mask, low + size)).bitwiseAND(F.lit(1).cast("long"))
        return F.when((ends == 1) & (F.bit_count(inside) == 1), mask.bitwiseXOR(F.call_function("shiftleft", inside, low + 1))).otherwise(mask)

    return F.aggregate(F.filter(edges, lambda e: e["chars"] > 1), start, merge)


def fold_viterbi(edges: str = "edges", word: str = "word") -> F.Column:
    """Ids of the best path by summed scores (a unigram model): the fold keeps, for each place, the best sum and the ids
    that lead there; ties go to the path found first in order of start and length."""
    unreached = F.struct(F.lit(float("-inf")).alias("score"), F.expr("CAST(array() AS ARRAY<INT>)").alias("ids"))
    start = F.transform(F.sequence(F.lit(0), F.length(word)), lambda i: F.when(i == 0, F.struct(F.lit(0.0).alias("score"), F.expr("CAST(array() AS ARRAY<INT>)").alias("ids"))).otherwise(unreached))
    in_order = F.array_sort(F.transform(edges, lambda e: F.struct(e["from"].cast("int").alias("from"), e["chars"].cast("int").alias("chars"), e["id"].alias("id"), e["score"].alias("score"))))

    def extend(best: F.Column, e: F.Column) -> F.Column:
        here, to = F.get(best, e["from"]), e["from"] + e["chars"]
        score = here["score"] + e["score"]
        return F.transform(best, lambda old, i: F.when((i == to) & (score > old["score"]), F.struct(score.alias("score"), F.concat(here["ids"], F.array(e["id"])).alias("ids"))).otherwise(old))

    return F.element_at(F.aggregate(in_order, start, extend), -1)["ids"]


def encode_words(words: DataFrame, table: DataFrame, pieces: Pieces) -> DataFrame:
    """word and ids of distinct (word) rows of up to MASKED characters under a byte-pair model, in Spark's own operators."""
    folded = lattice(words, table, pieces.longest).withColumn("mask", fold_merges())
    at = F.filter(F.sequence(F.lit(0), F.length("word")), lambda k: F.call_function("shiftright", F.col("mask"), k.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    spans = F.zip_with(F.slice("at", 1, F.size("at") - 1), F.slice("at", 2, F.size("at") - 1), lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    bytes_of = F.array(*(F.lit(int(i)) for i in pieces.byte_id))

    def spelt(s: F.Column) -> F.Column:
        found = F.filter("edges", lambda e: (e["from"] == s["a"]) & (e["chars"] == s["n"]))
        raw = F.hex(F.encode(F.substring("word", s["a"] + 1, s["n"]), "UTF-8"))
        spread = F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda k: F.get(bytes_of, F.conv(F.substring(raw, k, F.lit(2)), 16, 10).cast("int")))
        return F.when(F.size(found) > 0, F.array(F.get(found, 0)["id"])).otherwise(spread)

    return folded.withColumn("at", at).withColumn("spans", spans).select("word", F.flatten(F.transform("spans", spelt)).alias("ids"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"))
