"""SentencePiece encoding as a relational lattice.

Texts are cut into words where no piece of the model could lie across the cut. The distinct words
of the whole corpus go through the lattice once: all substrings up to the longest piece are
exploded, an equi-join with the piece table keeps those that are pieces, and the pieces of some
hundreds of words at a time are grouped as the edges of their lattices. A fold over them, step by
step for all words of a group at once, finds the paths: for a unigram model Viterbi, the best sum of
scores; for a BPE model the path is defined by its merges, best score first, so the fold applies
those. Characters without a piece become bytes.

Texts are handled in blocks of bounded size, each with the list of its own words, dealt into buckets
by their hash. Equal words meet in a bucket; the ids of a block's words come back to it, a row for
each bucket, and are laid out as the ids of its texts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import name
from plumbline.llm.common import body, once
from plumbline.llm.tokens import gathered, pieces_of
from plumbline.session import local_table, shared_path

SPACE = "\u2581"
FOLDED = 64               # words of up to so many characters are folded together, their bounds in 63 bits; longer ones one by one by the same rule
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
UNITS_AT_ONCE = 50_000    # runs between spaces cut into words, and words hashed, at once
LAID_OUT_AT_ONCE = 500_000    # words
GROUP_WORDS = 2_000       # words folded at once
BUCKET_TEXT = 4 << 20     # bytes of text for each bucket of words
BLOCK_TEXT = 16 << 20     # bytes of text per block; larger blocks repeat fewer words, smaller ones need less memory
UNKNOWN_PENALTY = 10.0    # a character without a piece scores so much below the worst piece


@dataclass(frozen=True)
class PieceModel:
    """``pieces`` are ``(piece, id, score)``; ``kind`` is ``bpe`` or ``unigram``; ``byte_id`` is the id of
    byte 0, the others follow; ``texts`` says for each id what it stands for."""

    pieces: tuple[tuple[str, int, float], ...]
    kind: str
    byte_id: int
    texts: tuple[bytes, ...]

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> PieceModel:
        """Read a model file that adds a leading space, normalises nothing else and falls back to bytes."""
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, texts = [], []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            plain = not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
            if plain:
                pieces.append((piece, i, sp.get_score(i)))
            texts.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace(SPACE, " ").encode() if plain else b"")
        return cls(tuple(pieces), kind, sp.piece_to_id("<0x00>"), tuple(texts))

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    def touching(self) -> frozenset[str]:
        """Pairs of characters that stand side by side in some piece."""
        return frozenset(p[i:i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1))


class _Touching:
    """Which characters stand side by side in some piece."""

    def __init__(self, model: PieceModel):
        pairs = [(ord(p[0]), ord(p[1])) for p in model.touching()]
        self.codes = np.unique(np.array([x << 21 | y for x, y in pairs], np.int64))
        self.ascii = np.zeros((128, 128), bool)
        for x, y in pairs:
            if x < 128 and y < 128:
                self.ascii[x, y] = True

    def cuts(self, text: str) -> np.ndarray:
        """Positions in ``text`` between characters that never touch."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        x, y = code[:-1], code[1:]
        plain = (x < 128) & (y < 128)
        met = self.ascii[np.where(plain, x, 0), np.where(plain, y, 0)] & plain
        other = np.flatnonzero(~plain)
        if len(other) and len(self.codes):
            pair = x[other] << 21 | y[other]
            met[other] = self.codes[np.minimum(np.searchsorted(self.codes, pair), len(self.codes) - 1)] == pair
        return np.flatnonzero(~met) + 1


def _split(units: pa.Array, touching: _Touching) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all units in order, and how many each unit has."""
    words, sizes = [pa.array([], pa.string())], [np.empty(0, np.int64)]
    for k in range(0, len(units), UNITS_AT_ONCE):
        some = units[k:k + UNITS_AT_ONCE].to_pylist()
        text = "".join(some)
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))])
        mark = np.zeros(len(text) + 1, bool)
        mark[begin] = True
        mark[touching.cuts(text)] = True
        ends = np.flatnonzero(mark).tolist()
        words.append(pa.array([text[a:b] for a, b in zip(ends, ends[1:])], pa.string()))
        sizes.append(np.diff((np.cumsum(mark) - 1)[begin]))
    return pa.concat_arrays(words).dictionary_encode(), np.concatenate(sizes)


def _laid_out(flat: np.ndarray, begin: np.ndarray, which: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``length`` elements of ``flat`` from ``begin[which]`` on, one piece after the other, and the bounds of the pieces."""
    upto = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    out = np.empty(int(upto[-1]), np.int32)
    for k in range(0, len(which), LAID_OUT_AT_ONCE):
        some = slice(k, min(k + LAID_OUT_AT_ONCE, len(which)))
        out[upto[some.start]:upto[some.stop]] = gathered(flat, begin[which[some]], length[some])
    return out, upto


def _coded(texts: pa.Array, touching: _Touching) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a block, the numbers of its words in order, and how many each text has."""
    odd = pc.or_(pc.match_substring_regex(texts, "  |^ | $"), pc.match_substring(texts, SPACE))
    split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    offsets = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
    units = split.values.dictionary_encode()
    del split
    plain = pc.binary_join_element_wise(SPACE, units.dictionary, "")
    # Runs of spaces belong to the word behind them.
    spaced = {k: WORD.findall(SPACE + texts[k].as_py().replace(" ", SPACE)) for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
    words, size = _split(pa.concat_arrays([plain, pa.array([u for own in spaced.values() for u in own], pa.string())]), touching)
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    first = np.cumsum(size) - size
    unit = units.indices.to_numpy(zero_copy_only=False)
    length = size.astype(np.int32)[unit]
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    unused = np.repeat(empty | odd.to_numpy(zero_copy_only=False), np.diff(offsets))
    length[unused] = 0
    codes, upto = _laid_out(code, first, unit, length)
    bounds = upto[offsets]
    if not spaced:
        return words.dictionary, codes, np.diff(bounds)
    parts, at = [codes[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())], len(plain)
    for k, own in spaced.items():
        until = at + len(own)
        parts[k] = code[first[at]:first[until - 1] + size[until - 1]]
        at = until
    return words.dictionary, np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def _packed(codes: np.ndarray) -> bytes:
    press = once("zstd", lambda: zstandard.ZstdCompressor(level=3))
    return press.compress(codes.astype("<i4").reshape(-1, 1).view("u1").T.tobytes())  # byte planes compress better


def _uncoded(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(once("unzstd", zstandard.ZstdDecompressor).decompress(packed), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def _plain(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, one after the other, and their bounds."""
    bounds = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    return data, bounds - bounds[0]


def _dealt(data: np.ndarray, bounds: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each word; it follows from the bytes of the word alone."""
    length = np.diff(bounds)
    powers = np.cumprod(np.full(int(length.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64))
    found = [np.empty(0, np.int32)]
    for k in range(0, len(length), UNITS_AT_ONCE):
        some, begin = length[k:k + UNITS_AT_ONCE], int(bounds[k])
        own, first = data[begin:begin + int(some.sum())], bounds[k:k + len(some)] - begin
        hashed = powers[np.arange(len(own)) - np.repeat(first, some)]
        hashed *= own.astype(np.uint64) + np.uint64(1)
        hashed = np.add.reduceat(hashed, first)
        hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append(((hashed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32))
    return np.concatenate(found)


BLOCK_ROW = "block long, doc_ids array<long>, sizes array<long>, codes binary, dealt binary, bucket long, words binary, lengths binary"


def _blocks(docs: DataFrame, model: PieceModel, buckets: int) -> DataFrame:
    """Per block one row of its texts (``doc_ids, sizes, codes``, and in ``dealt`` the bucket of each of its words) and one for
    each bucket that has words of it (``words``, all bytes, and ``lengths``), which keep the order they have in the block.

    The table is bucketed by ``block``: what is found for a block comes to it without its codes being dealt out again.
    """
    touching, spark = _Touching(model), docs.sparkSession

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        press = once("zstd", lambda: zstandard.ZstdCompressor(level=3))
        for seq, batch in enumerate(pieces_of(batches, "text", BLOCK_TEXT)):
            words, codes, sizes = _coded(batch["text"], touching)
            codes = _packed(codes)
            data, bounds = _plain(words)
            dealt = _dealt(data, bounds, buckets)
            order = np.argsort(dealt, kind="stable")
            used, first = np.unique(dealt[order], return_index=True)
            length = np.diff(bounds)[order]
            sorted_data, ends = gathered(data, bounds[:-1][order], length), np.concatenate([[0], np.cumsum(length)])
            cuts, m = [*first.tolist(), len(order)], len(used)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([base + seq] * (1 + m), pa.int64()),
                "doc_ids": pa.array([batch["doc_id"].to_pylist()] + [None] * m, pa.list_(pa.int64())),
                "sizes": pa.array([sizes.tolist()] + [None] * m, pa.list_(pa.int64())),
                "codes": pa.array([codes] + [None] * m, pa.binary()),
                "dealt": pa.array([_packed(dealt)] + [None] * m, pa.binary()),
                "bucket": pa.array([None, *used.tolist()], pa.int64()),
                "words": pa.array([None, *(press.compress(sorted_data[ends[a]:ends[b]].tobytes()) for a, b in zip(cuts, cuts[1:]))], pa.binary()),
                "lengths": pa.array([None, *(_packed(length[a:b]) for a, b in zip(cuts, cuts[1:]))], pa.binary())})

    table, parts = f"plumbline_blocks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    (docs.mapInArrow(deal, BLOCK_ROW).write.bucketBy(parts, "block").format("parquet").option("compression", "zstd")
     .option("path", shared_path(spark, "blocks")).saveAsTable(table))
    return spark.table(table)


def _gathered_words(rows: pa.Table) -> tuple[pa.DictionaryArray, list[int], np.ndarray]:
    """The words of a bucket in the order of their blocks, the blocks, and how many words each has.

    So the distinct words, numbered as they come, are the same for the same rows.
    """
    order = np.argsort(rows["block"].to_numpy(), kind="stable")
    press = once("unzstd", zstandard.ZstdDecompressor)
    data, lengths = rows["words"].to_pylist(), rows["lengths"].to_pylist()
    each = [_uncoded(lengths[k]) for k in order.tolist()]
    ends = np.concatenate([[0], np.cumsum(np.concatenate(each))]).astype(np.int32)
    text = b"".join(press.decompress(data[k]) for k in order.tolist())
    words = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(text))
    return words.dictionary_encode(), rows["block"].to_numpy()[order].tolist(), np.array([len(x) for x in each], np.int64)


def _distinct(key: tuple, rows: pa.Table) -> pa.Table:
    """The distinct words of a bucket, in groups."""
    words = _gathered_words(rows)[0].dictionary
    starts = list(range(0, len(words), GROUP_WORDS))
    offsets = pa.array([*starts, len(words)], pa.int32())
    return pa.table({"bucket": pa.array([key[0].as_py()] * len(starts), pa.int64()), "start": pa.array(starts, pa.int32()),
                     "words": pa.ListArray.from_arrays(offsets, words)})


def lattice(words: DataFrame, model: PieceModel) -> DataFrame:
    """``bucket, start, w, a, b, id, spelt``: an edge for every piece in each ``bucket, start, w, word``.

    A character without a piece has an edge with a null id, and is told as ``spelt``.
    """
    spark = words.sparkSession
    pieces = local_table(spark, [(p, i) for p, i, _ in model.pieces], "piece string, id int")
    n = F.length("word")
    spans = (words.withColumn("a", F.explode(F.sequence(F.lit(0), n - 1)))
             .withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), n - F.col("a")))))
             .withColumn("piece", F.substring("word", F.col("a") + 1, F.col("size"))))
    edges = (spans.join(F.broadcast(pieces), "piece", "left")  # bounded by the vocabulary
             .where(F.col("id").isNotNull() | (F.col("size") == 1)))
    return edges.select("bucket", "start", "w", "a", (F.col("a") + F.col("size")).alias("b"), "id",
                        F.when(F.col("id").isNull(), F.col("piece")).alias("spelt"))


def _merged(w: np.ndarray, a: np.ndarray, b: np.ndarray, order: np.ndarray, bounds: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bounds of the tokens of each word after all merges: each step applies the best edge made of two tokens.

    Edges that cross an applied one or lie in it can never be applied again and go.
    """
    long = np.flatnonzero(b - a > 1)
    long = long[np.lexsort((a[long], order[long], w[long]))]
    w, ends, inside = w[long], _ends(a[long], b[long], n[w[long]]), _inside(a[long], b[long])
    while len(w):
        own = bounds[w]
        within = own & inside
        alive = ((own & ends) == ends) & (within != 0)
        w, ends, inside, within = w[alive], ends[alive], inside[alive], within[alive]
        two = np.flatnonzero((within & (within - np.uint64(1))) == 0)
        best = two[np.diff(w[two], prepend=-1) != 0]
        if not len(best):
            break
        bounds[w[best]] &= ~inside[best]
    return bounds


def _viterbi(w: np.ndarray, a: np.ndarray, b: np.ndarray, order: np.ndarray, bounds: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bounds of the path of each word with the least sum of ``order``; of equal ones that with the longest last piece."""
    cost = np.zeros((len(n), int(n.max(initial=0)) + 1))
    back = np.zeros(cost.shape, np.int64)
    for end in range(1, cost.shape[1]):
        some = np.flatnonzero(b == end)
        sums = cost[w[some], a[some]] + order[some]
        rank = np.lexsort((a[some], sums, w[some]))
        first = rank[np.diff(w[some][rank], prepend=-1) != 0]
        cost[w[some][first], end], back[w[some][first], end] = sums[first], a[some][first]
    bounds, at, word = np.zeros_like(bounds), n.copy(), np.arange(len(n))
    while len(word):
        at = back[word, at]
        word, at = word[at > 0], at[at > 0]
        bounds[word] |= np.uint64(1) << (at - 1).astype(np.uint64)
    return bounds


def _bit(place: np.ndarray) -> np.ndarray:
    """The bit of a place between two characters; it is set in the bounds of a word where a token ends."""
    return np.where(place > 0, np.uint64(1) << np.maximum(place - 1, 0).astype(np.uint64), np.uint64(0))


def _inside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.uint64(1) << (b - 1).astype(np.uint64)) - (np.uint64(1) << a.astype(np.uint64))


def _ends(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    return _bit(a) | np.where(b < n, _bit(b), np.uint64(0))


TOLD = "bucket long, start int, w array<int>, sizes array<int>, ids array<int>"


def encode_words(words: DataFrame, model: PieceModel) -> DataFrame:
    """Ids of distinct words, which must hold no cut, for each ``bucket, start`` in lists: ``w``, how many ids it has, all ids.

    ``w`` tells the words of a ``bucket, start`` apart.
    """
    worst = min((s for _, _, s in model.pieces if s > -1e8), default=0.0) - UNKNOWN_PENALTY
    orders = np.full(len(model.texts) + 1, -worst)  # the last is that of no piece
    for _, i, s in model.pieces:
        orders[i] = -s

    def fold(key: tuple, edges: pa.Table) -> pa.Table:
        number, w = np.unique(edges["w"].to_numpy(), return_inverse=True)
        a, b = (edges[c].to_numpy().astype(np.int64) for c in "ab")
        piece = edges["id"].fill_null(-1).to_numpy()
        n = np.zeros(len(number), np.int64)
        np.maximum.at(n, w, b)
        every = np.where(n > 1, (np.uint64(1) << np.maximum(n - 1, 0).astype(np.uint64)) - np.uint64(1), np.uint64(0))
        bounds = (_merged if model.kind == "bpe" else _viterbi)(w, a, b, orders[piece], every, n)
        ends = _ends(a, b, n[w])
        path = np.flatnonzero((bounds[w] & (ends | _inside(a, b))) == ends)
        path = path[np.lexsort((a[path], w[path]))]
        owner, ids = w[path], piece[path]
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            spelt = [t.encode("utf-8", "surrogatepass") for t in edges["spelt"].take(pa.array(path[odd])).to_pylist()]
            size = np.ones(len(path), np.int64)
            size[odd] = [len(t) for t in spelt]
            owner, ids, unspelt = np.repeat(owner, size), np.repeat(ids, size), np.repeat(ids < 0, size)
            ids[unspelt] = model.byte_id + np.frombuffer(b"".join(spelt), np.uint8).astype(np.int64)
        lists = [[x.tolist()] for x in (number, np.bincount(owner, minlength=len(number)), ids)]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "start": pa.array([key[1].as_py()], pa.int32()),
                         **{c: pa.array(x, pa.list_(pa.int32())) for c, x in zip(("w", "sizes", "ids"), lists)}})

    folded = lattice(words.where(F.length("word") <= FOLDED), model).groupBy("bucket", "start").applyInArrow(fold, TOLD)
    long = words.where(F.length("word") > FOLDED)

    @F.pandas_udf("array<int>")
    def by_hand(some):
        table = {p: (i, s) for p, i, s in model.pieces}
        return some.map(lambda w: encode_word(w, table, model))

    long = long.select("bucket", "start", F.array("w").alias("w"), by_hand("word").alias("ids"))
    return folded.unionByName(long.withColumn("sizes", F.array(F.size("ids"))))


def encode_word(word: str, table: dict[str, tuple[int, float]], model: PieceModel) -> list[int]:
    """The ids of one word of any length by the same rules as the fold."""
    import heapq

    worst, n = min((s for _, s in table.values() if s > -1e8), default=0.0) - UNKNOWN_PENALTY, len(word)
    if model.kind == "bpe":
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that begins there
        alive, heap = [True] * n, []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (hit := table.get(word[a:after[b]])):
                heapq.heappush(heap, (-hit[1], a, after[b], b))

        for a in range(n):
            offer(a)
        while heap:
            _, a, end, b = heapq.heappop(heap)
            if alive[a] and after[a] == b and b < n and alive[b] and after[b] == end:
                alive[b], after[a] = False, end
                if end < n:
                    before[end] = a
                if before[a] >= 0:
                    offer(before[a])
                offer(a)
        bounds = [a for a in range(n) if alive[a]] + [n]
    else:
        best, longest = [(0.0, 0)], model.longest
        for b in range(1, n + 1):
            ways = [(best[a][0] - hit[1], a) for a in range(max(0, b - longest), b) if (hit := table.get(word[a:b]))]
            if word[b - 1] not in table:
                ways.append((best[b - 1][0] - worst, b - 1))
            best.append(min(ways))
        bounds = [n]
        while bounds[-1]:
            bounds.append(best[bounds[-1]][1])
        bounds.reverse()
    out: list[int] = []
    for a, b in zip(bounds, bounds[1:]):
        hit = table.get(word[a:b])
        out += [hit[0]] if hit else [model.byte_id + x for x in word[a:b].encode("utf-8", "surrogatepass")]
    return out


def encode(docs: DataFrame, model: PieceModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids`` of every whole text, one row per input row.

    A null or empty text has no ids; null ids of documents stay null; other columns are not read.
    Ids must be integers. The ids are those of the model's own library.
    """
    texts = docs.select(name(id_column).cast("long").alias("doc_id"), body(text_column).alias("text"))
    buckets = 1 + (texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // BUCKET_TEXT
    blocks = _blocks(texts, model, buckets)
    dealt = blocks.where(F.col("bucket").isNotNull()).select("block", "bucket", "words", "lengths")
    groups = dealt.groupBy("bucket").applyInArrow(_distinct, "bucket long, start int, words array<string>")
    # A word becomes many substrings: small partitions, and all edges of a group stay in its own.
    spread = groups.repartition(buckets, "bucket", "start")
    words = spread.select("bucket", "start", F.posexplode("words").alias("w", "word"))
    told = encode_words(words, model)

    def answer(own: pa.Table, dictionary: pa.Table) -> pa.Table:
        coded, block, size = _gathered_words(own)
        many = pc.list_value_length(dictionary["w"]).to_numpy()
        w = np.repeat(dictionary["start"].to_numpy(), many) + dictionary["w"].combine_chunks().flatten().to_numpy()
        sizes = dictionary["sizes"].combine_chunks().flatten().to_numpy().astype(np.int64)
        begin, length = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        begin[w], length[w] = np.cumsum(sizes) - sizes, sizes
        word = coded.indices.to_numpy()
        ids = gathered(dictionary["ids"].combine_chunks().flatten().to_numpy(), begin[word], length[word])
        cuts = np.concatenate([[0], np.cumsum(size)])
        ends = np.concatenate([[0], np.cumsum(length[word])])[cuts].tolist()
        cuts = cuts.tolist()
        return pa.table({"home": pa.array(block, pa.int64()), "bucket": pa.array([own["bucket"][0].as_py()] * len(block), pa.int64()),
                         "lengths": pa.array([_packed(length[word[a:b]]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                         "ids": pa.array([_packed(ids[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())})

    known = dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(answer, "home long, bucket long, lengths binary, ids binary")

    def lay_out(own: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found["bucket"].to_numpy(), kind="stable").tolist()
        lengths, flat = ([_uncoded(x) for x in (found[c].to_pylist()[k] for k in order)] for c in ("lengths", "ids"))
        sizes, flat = (np.concatenate([np.empty(0, np.int32), *x]) for x in (lengths, flat))
        # The rows tell the words bucket by bucket, and in a bucket in the order of their numbers.
        number = np.argsort(_uncoded(own["dealt"][0].as_py()), kind="stable")
        begin, size = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        begin[number], size[number] = np.cumsum(sizes, dtype=np.int64) - sizes, sizes
        word, doc_ids = _uncoded(own["codes"][0].as_py()), own["doc_ids"].combine_chunks().flatten()
        counts = np.concatenate([[0], np.cumsum(own["sizes"].combine_chunks().flatten().to_numpy())])
        parts, k = [], 0
        while k < len(doc_ids):  # some texts at a time, so that the rows leave in batches of bounded size
            until = max(k + 1, int(np.searchsorted(counts, counts[k] + LAID_OUT_AT_ONCE, "right")) - 1)
            some = word[counts[k]:counts[until]]
            ends = np.concatenate([[0], np.cumsum(size[some])])[counts[k:until + 1] - counts[k]]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(gathered(flat, begin[some], size[some]), pa.int32()))
            parts.append(pa.RecordBatch.from_arrays([doc_ids[k:until], ids], names=["doc_id", "ids"]))
            k = until
        return pa.Table.from_batches(parts)

    codes = blocks.where(F.col("codes").isNotNull()).select("block", "doc_ids", "sizes", "codes", "dealt")
    return codes.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(lay_out, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: PieceModel, ids_column: str = "ids", alias: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids: pieces joined, bytes restored, the leading space dropped.

    Null ids give null; ids that stand for nothing give nothing.
    """
    spelt = F.expr("array(" + ", ".join(f"'{t.hex()}'" for t in model.texts) + ")")  # one literal, bounded by the vocabulary
    raw = F.unhex(F.array_join(F.transform(name(ids_column), lambda i: F.get(spelt, i)), ""))
    text = F.decode(raw, "UTF-8")
    return encoded.withColumn(alias, F.when(text.startswith(" "), F.substring(text, 2, 2**31 - 1)).otherwise(text))

