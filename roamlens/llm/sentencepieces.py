"""SentencePiece encoding by a relational lattice, and decoding."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from roamlens.llm.common import carried, staged

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
HOT = 1 << 18  # most frequent words whose pieces are broadcast
FLUSH = 1 << 16  # distinct words that a task counts before it hands them on
PAIR_BITS = 20  # of the table of neighbours; of numbers alike one stands for all
PART = 1 << 18  # characters looked at at once
REMEMBERED = 1 << 15  # chunks whose words or pieces a worker remembers
SLICE = 1 << 21  # bytes of text looked at at once
SAMPLES = 400  # texts that the compressor's dictionary is made from
BLOCK = 10_000  # distinct words of a partition while their lattices are built
LONG = 512  # characters of a word from which on its path is found piece by piece in one pass
UNKNOWN_PENALTY = 10.0
_CHUNK = re.compile(" +[^ ]*")


class Vocabulary:
    """Pieces of a SentencePiece model file: ids, scores, byte fallbacks, and
    which neighbouring characters some piece holds together."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.bytes, self.decoded = [], {}, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                octet = int(piece[3:5], 16)
                self.bytes[octet] = i
                self.decoded.append(bytes([octet]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.decoded.append(b"")
            else:
                if re.search(f"[^{SPACE}]{SPACE}", piece):
                    raise ValueError(f"piece {piece!r} goes on after a space")
                self.pieces.append((piece, i, float(sp.get_score(i))))
                self.decoded.append(piece.replace(SPACE, " ").encode())
        self.joined = np.zeros(1 << PAIR_BITS, bool)
        for piece, _, _ in self.pieces:
            self.joined[_pairs(np.frombuffer(piece.encode("utf-32-le"), np.uint32))] = True
        self.unknown_id = sp.unk_id()
        self.longest = max(len(p) for p, _, _ in self.pieces)
        self.unknown_score = min(s for _, _, s in self.pieces) - UNKNOWN_PENALTY

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.pieces, "piece STRING, id INT, score DOUBLE")

    def fallback(self) -> list[int]:
        """Ids of the 256 bytes; the unknown id where the model has none."""
        return [self.bytes.get(b, self.unknown_id) for b in range(256)]


def _pairs(codes: np.ndarray) -> np.ndarray:
    """A number of PAIR_BITS bits for every two neighbouring characters."""
    c = codes.astype(np.uint64)
    h = (c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def chunks_of(text: str | None) -> list[str]:
    """A text cut before its spaces, each part without the one space that it
    begins with (the first part begins with the mark of the text's start). More
    spaces in a row belong to the part after them, or are one at the end."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if text[0] != " " and text[-1] != " " and "  " not in text:
        return text.split(" ")
    return [c[1:] for c in _CHUNK.findall(" " + text)]


def cut(chunks: list[str], joined: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The words of all chunks and the chunk that each is from: cuts wherever no
    piece holds the two neighbours together. The best path never crosses a cut,
    so it is the words' best paths in turn. (Two pairs may share a number in
    ``joined``; then a cut is left out, which changes no path.)"""
    words, owner = [], []
    at = 0
    while at < len(chunks):  # so many characters at once, for memory
        size, stop = 0, at
        while stop < len(chunks) and (stop == at or size + len(chunks[stop]) < PART):
            size += len(chunks[stop]) + 1
            stop += 1
        marked = [SPACE + c.replace(" ", SPACE) if " " in c else SPACE + c for c in chunks[at:stop]]
        whole = "".join(marked)
        begin = np.cumsum([0, *map(len, marked)])
        first = np.zeros(len(whole) + 1, bool)
        first[begin] = True
        first[1:-1] |= ~joined[_pairs(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32))]
        bounds = np.flatnonzero(first)
        owner.append(at + np.searchsorted(begin, bounds[:-1], "right") - 1)
        bounds = bounds.tolist()
        words += [whole[x:y] for x, y in zip(bounds, bounds[1:])]
        at = stop
    return words, np.concatenate(owner) if owner else np.zeros(0, np.int64)


def words_of(text: str | None, joined: np.ndarray) -> list[str]:
    return cut(chunks_of(text), joined)[0]


def _counter(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            chunks = list(seen)
            words, owner = cut(chunks, shipped.value)
            counts = np.fromiter(seen.values(), np.int64, len(chunks))[owner].tolist() if chunks else []
            total: dict[str, int] = {}
            for w, n in zip(words, counts):
                total[w] = total.get(w, 0) + n
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"]
            )

        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(chunks_of(t.as_py()))
                if len(seen) >= FLUSH:
                    yield out()
        yield out()

    return run


def word_counts(docs: DataFrame, joined) -> DataFrame:
    """(word, n): every distinct word of ``docs`` (text), counted task by task
    first. ``joined``: the broadcast table of the vocabulary."""
    counted = docs.select("text").mapInArrow(_counter(joined), "word STRING, n BIGINT")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _best_path(edges: Column, length: Column) -> Column:
    """Viterbi over one word. ``edges``: for each end, in order, the edges
    {begin, id, score} that end there. Gives the ids of the best path."""
    state = "array<struct<score:double,nearest:int,id:int>>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("nearest"), F.lit(-1).alias("id"))).cast(state)
    forward = F.aggregate(
        edges,
        start,
        lambda best, ending: F.concat(best, F.array(F.array_max(F.transform(
            ending,
            # of equal scores the longest last piece, which begins first
            lambda e: F.struct(
                (F.get(best, e["begin"])["score"] + e["score"]).alias("score"), (-e["begin"]).alias("nearest"), e["id"].alias("id"),
            ),
        )))).cast(state),
    )
    walk = F.struct(forward.alias("best"), length.alias("at"), F.array().cast("array<int>").alias("ids"))
    return F.aggregate(
        F.sequence(F.lit(1), length),
        walk,
        lambda acc, _: F.when(acc["at"] > 0, F.struct(
            acc["best"].alias("best"),
            (-F.get(acc["best"], acc["at"])["nearest"]).alias("at"),
            F.concat(acc["ids"], F.array(F.get(acc["best"], acc["at"])["id"])).alias("ids"),
        )).otherwise(acc),
        lambda acc: F.reverse(acc["ids"]),
    )


def encode_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, ids) for every distinct ``word``: the path of the highest total score.

    Substrings of bounded length are exploded and joined with the piece table,
    which is of fixed size and broadcast; the edges stay in their word's
    partition, of a bounded number of words, where they are grouped by end and
    folded. A character that is no piece gets an edge with the unknown score and is
    spelled in bytes. Words of over ``LONG`` characters, which are runs without a
    place to cut, are walked in one pass each (``_walked``): a fold over arrays
    would take the square of their length.
    """
    spark = words.sparkSession
    long = words.filter(F.char_length("word") > LONG).select("word")
    words = words.filter(F.char_length("word") <= LONG)
    parts_of = max(1, -(-words.count() // BLOCK))
    dealt = words.select("word").repartition(parts_of, "word")
    ends = dealt.select("word", F.char_length("word").alias("n")).select(
        "word", "n", F.explode(F.sequence(F.lit(1), "n")).alias("end")
    )
    parts = ends.select(
        "word", "n", "end",
        F.explode(F.sequence(F.greatest(F.col("end") - vocabulary.longest, F.lit(0)), F.col("end") - 1)).alias("begin"),
    ).select("word", "n", "end", "begin", F.substring("word", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("piece"))
    fallback = (F.col("id").isNull()) & (F.col("end") - F.col("begin") == 1)
    edges = parts.join(F.broadcast(vocabulary.table(spark)), "piece", "left").filter(
        F.col("id").isNotNull() | (F.col("end") - F.col("begin") == 1)
    )
    # an unknown character's id is -2 - its code point until the path is known
    edge = F.struct(
        "end", "begin",
        F.when(fallback, -2 - F.ascii("piece")).otherwise(F.col("id")).cast("int").alias("id"),
        F.when(fallback, F.lit(vocabulary.unknown_score)).otherwise(F.col("score")).alias("score"),
    )
    grouped = edges.groupBy("word").agg(F.max("n").alias("n"), F.collect_list(edge).alias("edges"))
    by_end = F.transform(F.sequence(F.lit(1), "n"), lambda e: F.filter("edges", lambda x: x["end"] == e))
    path = grouped.select("word", _best_path(by_end, F.col("n")).alias("path"))
    octets = F.array(*[F.lit(i) for i in vocabulary.fallback()])

    def spelled(i: Column) -> Column:
        code = -2 - i
        low = lambda shift: F.shiftright(code, shift).bitwiseAND(F.lit(63)) + 128
        utf8 = (
            F.when(code < 0x80, F.array(code))
            .when(code < 0x800, F.array(F.shiftright(code, 6) + 192, low(0)))
            .when(code < 0x10000, F.array(F.shiftright(code, 12) + 224, low(6), low(0)))
            .otherwise(F.array(F.shiftright(code, 18) + 240, low(12), low(6), low(0)))
        )
        return F.when(i >= 0, F.array(i)).otherwise(F.transform(utf8, lambda b: F.get(octets, b)))

    known = ~F.exists("path", lambda i: i < 0)
    short = path.select(
        "word", F.when(known, F.col("path")).otherwise(F.flatten(F.transform("path", spelled))).alias("ids")
    )
    shipped = spark.sparkContext.broadcast((
        {p: (i, x) for p, i, x in vocabulary.pieces}, vocabulary.longest, vocabulary.unknown_score, vocabulary.fallback()
    ))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word in batch.column(0).to_pylist():
                ids = pa.array([_walked(word, *shipped.value)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([word], pa.string()), ids], ["word", "ids"])

    return short.unionByName(long.mapInArrow(walked, "word STRING, ids ARRAY<INT>"))


def _walked(word: str, pieces: dict, longest: int, unknown: float, octets: list[int]) -> list[int]:
    """The same best path in one pass over a long word, in time proportional to its length."""
    best, come = [0.0], [0]
    for end in range(1, len(word) + 1):
        top, start = -math.inf, 0
        for begin in range(max(0, end - longest), end):  # of equal scores the longest last piece
            found = pieces.get(word[begin:end])
            if found is not None or begin == end - 1:
                score = best[begin] + (unknown if found is None else found[1])
                if score > top:
                    top, start = score, begin
        best.append(top)
        come.append(start)
    ids: list[list[int]] = []
    end = len(word)
    while end:
        piece = word[come[end]:end]
        found = pieces.get(piece)
        ids.append([octets[b] for b in piece.encode("utf-8", "surrogatepass")] if found is None else [found[0]])
        end = come[end]
    return [i for part in reversed(ids) for i in part]


def _whole(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _bytes_of(ids: pa.Array) -> tuple[np.ndarray, bytes]:
    """Lists of ids as one row of bytes and the places where each list begins and ends."""
    lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    return np.cumsum([0, *lengths]) * 4, ids.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()


def _slices(batch: pa.RecordBatch, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with up to SLICE bytes of text, or one longer row."""
    total = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _fresh(lists: list[list[str]], remembered: dict) -> list[str]:
    """The chunks that are not remembered; forgets the others when they are too many."""
    chunks = set().union(*lists)
    if len(remembered) > REMEMBERED:
        remembered.clear()
    return [c for c in chunks if c not in remembered]


def _places(words: list[str], known: pa.Array) -> np.ndarray:
    """The place of each word in ``known``, -1 where it is none of them."""
    return pc.fill_null(pc.index_in(pa.array(words, pa.string()), value_set=known), -1).to_numpy(zero_copy_only=False)


def _text_of(ids: list[int], piece: Callable[[int], bytes]) -> str:
    return b"".join(map(piece, ids))[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, carry: bool = False, hot: int = HOT, round_trip: bool = False) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text): piece ids of the whole text.

    Words are counted and every distinct one is encoded once. The pieces of the
    ``hot`` most frequent words are broadcast, a table of fixed size; the other
    words of a text are looked up by a join on the word and come back to all
    rows with the same text, which travel compressed. Null and empty texts have
    no ids. Rows with equal doc_id are encoded one by one. ``carry`` adds the
    struct ``carried`` with all columns of ``docs`` but the text; else they are
    ignored. ``round_trip`` adds the column ``decoded`` as ``decode`` does, from the
    ids, by the worker that has put them together.
    """
    spark = docs.sparkSession
    joined = spark.sparkContext.broadcast(vocabulary.joined)
    counts = staged(word_counts(docs, joined))
    pieces = staged(encode_words(counts, vocabulary))
    top = counts.orderBy(F.desc("n"), "word").limit(hot).select("word")
    frequent = pieces.join(top, "word", "left_semi").select("word", "ids").toArrow().combine_chunks()
    shipped = spark.sparkContext.broadcast((_whole(frequent["word"]), *_bytes_of(_whole(frequent["ids"]))))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table, others_of = shipped.value[0], joined.value, {}
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0)
            for rows in _slices(batch, lengths.to_pylist()):
                keys, words = [], []
                lists = [chunks_of(t) for t in rows.column("text").to_pylist()]
                fresh = _fresh(lists, others_of)
                cuts, owner = cut(fresh, table)
                others_of.update(dict.fromkeys(fresh, ()))
                for i in np.flatnonzero(_places(cuts, known) < 0).tolist():
                    others_of[fresh[owner[i]]] += (cuts[i],)
                for key, chunks in zip(rows.column("key").to_pylist(), lists):
                    others = {w for c in set(chunks) for w in others_of[c]}
                    words += others
                    keys += [key] * len(others)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string())], ["key", "word"])

    dictionary = _compression(docs)

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress
        for batch in batches:
            at = batch.schema.get_field_index("text")
            packed = pa.array([squeeze((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(at)], pa.binary())
            yield batch.set_column(at, "text", packed)

    keyed = docs.select(F.xxhash64("text").alias("key"), "text")
    # one shuffle by the word serves distinct and join; a word of many copies is frequent, so none is hot here
    wanted = keyed.mapInArrow(rare, "key BIGINT, word STRING").repartition("word").distinct()
    looked_up = wanted.join(pieces, "word").groupBy("key").agg(F.collect_list(F.struct("word", "ids")).alias("others"))
    rest = [carried(docs, "text")] * carry
    source = docs.select(F.xxhash64("text").alias("key"), "doc_id", "text", *rest)
    packed = StructType([StructField("text", BinaryType()) if f.name == "text" else f for f in source.schema])
    source = source.mapInArrow(compressed, packed).join(looked_up, "key", "left").drop("key")
    names = [c for c in source.columns if c not in ("text", "others")]

    pieces_of = spark.sparkContext.broadcast(vocabulary.decoded)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, offsets, ids), table, ids_of = shipped.value, joined.value, {}
        piece = pieces_of.value.__getitem__
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress
        for batch in batches:
            for rows in _slices(batch, [zstandard.frame_content_size(t) for t in batch.column("text").to_pylist()]):
                lists = [chunks_of(expand(t).decode("utf-8", "surrogatepass")) for t in rows.column("text").to_pylist()]
                others = pa.StructArray.flatten(rows.column("others").flatten())
                bounds, packs = _bytes_of(others[1])
                own = {w: packs[x:y] for w, x, y in zip(others[0].to_pylist(), bounds, bounds[1:])}
                fresh = _fresh(lists, ids_of)
                cuts, owner = cut(fresh, table)
                parts: list[list[bytes]] = [[] for _ in fresh]
                for w, k, i in zip(cuts, owner.tolist(), _places(cuts, known).tolist()):
                    parts[k].append(own[w] if i < 0 else ids[offsets[i]:offsets[i + 1]])
                ids_of.update(zip(fresh, map(b"".join, parts)))
                data = [b"".join(map(ids_of.__getitem__, chunks)) for chunks in lists]
                ends = pa.array(np.cumsum([0, *map(len, data)]) // 4, pa.int32())
                values = pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join(data))])
                back = [pa.array([_text_of(np.frombuffer(d, "<i4").tolist(), piece) for d in data], pa.string())] * round_trip
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(n) for n in names), pa.ListArray.from_arrays(ends, values), *back], [*names, "ids"] + ["decoded"] * round_trip
                )

    made = [StructField("ids", ArrayType(IntegerType())), *[StructField("decoded", StringType())] * round_trip]
    schema = StructType([source.schema[n] for n in names] + made)
    return source.mapInArrow(assemble, schema)


def _compression(docs: DataFrame) -> bytes:
    """A dictionary for compressing single texts, made from a few of them."""
    texts = [r.text.encode("utf-8", "surrogatepass")[:20_000] for r in docs.select("text").limit(SAMPLES).collect() if r.text]
    if sum(map(len, texts)) < 1 << 19:
        return (b" " * 64 + b"".join(texts))[: 1 << 16]  # too few to learn from: the texts themselves
    return zstandard.train_dictionary(1 << 16, texts).as_bytes()


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` with the column ``decoded``: the text of its ``ids``.

    Pieces and byte fallbacks are joined, space marks become spaces and the one
    that stands for the start of the text is dropped. Bytes that are no UTF-8
    become U+FFFD; null ids give null. encode then decode returns every text
    that has no U+2581 of its own, which comes back as a space.
    """
    shipped = encoded.sparkSession.sparkContext.broadcast(vocabulary.decoded)
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = shipped.value.__getitem__
        for batch in batches:
            texts = []
            for ids in batch.column(at):
                ids = ids.as_py() if not ids.is_valid else ids.values.to_numpy().tolist()
                texts.append(None if ids is None else _text_of(ids, piece))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema, StructField("decoded", StringType())]))
