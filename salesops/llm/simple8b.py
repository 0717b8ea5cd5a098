"""Token ids in Simple-8b words: encoding with selectors and escapes, a block file format, its reader.

Every 64-bit word holds a 4-bit selector in its top bits and as many ids as fit one of the widths in
the other 60. Selectors 0 and 1 stand for runs of 240 and 120 zeros. An id of over 60 bits does not
fit: selector 15 doubles as the escape, a word with a zero payload below it, and the next word holds
the id in full.

File format (Parquet, so that Spark commits, splits and reads the files from any store): one row per
block of whole documents, in ascending order of doc_id over the rows of a file and over the files.

| column | content |
| --- | --- |
| shard, block | place of the block: number of the range of ids, number in that range |
| doc_ids, lengths | documents of the block and their numbers of ids, in order |
| n_tokens | ids of the block |
| offsets | word at which each run of ``CHUNK`` ids of the block starts, for decoding runs apart |
| words | the 64-bit words, little-endian |

Defined results: a null text is an empty one and still gets the end id; a null doc_id comes first;
documents of one id stand beside each other in the order of their texts; an empty table writes no
block and reads back as no rows; other columns are not looked at.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesops.llm.common import written
from salesops.plans.lineage import scratch_path

# Ids per word and bits per id by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

ESCAPE = 15
# Ids per run between two offsets.
CHUNK = 65_536
# A block is closed once it holds so many ids; a document is never split.
BLOCK_TOKENS = 262_144
# Characters of text tokenised at a time, but one document at least.
BATCH_CHARS = 3_000_000
# Pieces of words whose ids a worker keeps from one portion to the next.
CACHE_WORDS = 300_000

BLOCK_SCHEMA = (
    "shard int, block int, doc_ids array<long>, lengths array<long>, n_tokens long, "
    "offsets array<int>, words binary"
)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    if not len(ids) or int(ids.max()) < 1 << 53:
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    return np.fromiter((int(x).bit_length() for x in ids), dtype=np.uint8, count=len(ids))


def _choices(width: np.ndarray) -> np.ndarray:
    """For every place, the selector that holds the most ids from there on.

    Behind the last id stand zeros, which fill up the last word; runs of zeros count only real ids.
    """
    n = len(width)
    padded = np.concatenate([width, np.zeros(COUNTS[0], dtype=np.uint8)])
    best = np.full(n, ESCAPE, dtype=np.uint8)
    for s in range(ESCAPE - 1, -1, -1):
        small = padded <= BITS[s]
        if np.count_nonzero(small[:n]) == 0:
            break
        # All of the next `count` places are small: double the span that is known to be small.
        span, count = 1, int(COUNTS[s])
        while span < count:
            step = min(span, count - span)
            small = small[: len(small) - step] & small[step:]
            span += step
        fits = small[:n].copy()
        if s < 2:
            fits[max(0, n - count + 1) :] = False
        best[fits] = s
    return best


def _walk(steps: np.ndarray) -> np.ndarray:
    """The places that steps from the first one reach: every 16th by a loop, those between by doubling."""
    n = len(steps)
    jumps = [np.append(np.minimum(np.arange(n) + steps, n), n)]
    for _ in range(4):
        jumps.append(jumps[-1][jumps[-1]])
    far, starts, i = memoryview(jumps.pop()), [], 0
    while i < n:
        starts.append(i)
        i = far[i]
    starts = np.array(starts, dtype=np.int64)
    for jump in reversed(jumps):
        starts = np.stack([starts, jump[starts]], axis=1).ravel()
    return starts[starts < n]


def encode_words(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of the ids (unsigned), packed greedily: every word takes as many ids as it can."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    width = _widths(ids)
    best = _choices(width)
    starts = _walk(COUNTS[best])
    selectors = best[starts]
    out = selectors.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(COUNTS[0], dtype=np.uint64)])
    for s in np.unique(selectors):
        at = np.flatnonzero(selectors == s)
        for k in range(int(COUNTS[s]) if s >= 2 else 0):
            value = padded[starts[at] + k]
            if s == ESCAPE:
                value = np.where(width[starts[at]] > 60, np.uint64(0), value)
            out[at] |= value << np.uint64(k * BITS[s])
    # A word that holds one id too wide for it, or one zero, reads as an escape: the id follows in full.
    escaped = (selectors == ESCAPE) & ((width[starts] > 60) | (width[starts] == 0))
    where = np.flatnonzero(escaped)
    return np.insert(out, where + 1, ids[starts[where]]) if len(where) else out


def decode_words(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of Simple-8b words."""
    words = np.asarray(words, dtype=np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    payload = words & np.uint64((1 << 60) - 1)
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero((selectors == ESCAPE) & (payload == 0)):
        # An escape counts only where it is not itself the full id of an earlier one.
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    escape = np.zeros(len(words), dtype=bool)
    escape[:-1] = raw[1:]
    counts = np.where(raw, 1, np.where(escape, 0, COUNTS[selectors]))
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    starts = ends - counts
    out[starts[raw]] = words[raw]
    for s in range(2, 16):
        at = np.flatnonzero((selectors == s) & ~raw & ~escape)
        if not len(at):
            continue
        bits, mask = np.uint64(BITS[s]), np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            out[starts[at] + k] = (payload[at] >> (bits * np.uint64(k))) & mask
    return out[:n]


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a block and the offset of every run of CHUNK ids."""
    parts = [encode_words(ids[i : i + CHUNK]) for i in range(0, len(ids), CHUNK)]
    offsets = np.cumsum([0, *[len(p) for p in parts]])[:-1] if parts else np.zeros(0, int)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), offsets


def decode_block(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Ids of a block; each run of CHUNK ids is decoded from its own offset."""
    bounds = [*offsets.tolist(), len(words)]
    runs = [
        decode_words(words[bounds[i] : bounds[i + 1]], min(CHUNK, n - i * CHUNK)) for i in range(len(offsets))
    ]
    return np.concatenate(runs) if runs else np.zeros(0, np.uint64)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all ranges, one behind the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


# As classes of letters: lower-case ones that normalising leaves alone; ASCII marks, a run of which is one piece.
_LETTERS, _MARKS = "a-zß-öø-ÿœ", r"!-/:-@\[-`{-~"


class WordTokenizer:
    """Ids of whole texts, by a tokenizers file.

    Where the tokenizer drops white space and joins nothing across it (``split_words``), texts are
    put together from the ids of their pieces: plain letters, the marks behind them, and any other
    word as a whole. Each distinct piece is tokenised once while the cache holds it. ASCII letters
    are lower-cased first, as the tokenizer does itself. Plain pieces skip the normaliser and the
    splitting pattern, which would not change them; the first pieces fill the cache, as the frequent
    ones come early.
    """

    # Letters without case, one of which parts words given to the tokenizer in one go; it must be one id.
    _PARTERS = ("ツ", "ก", "م", "の", "的")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.parter = next((c for c in self._PARTERS if len(self.ids(c)) == 1), None)
        self.by_word = self.parter is not None and split_words(path)
        if self.by_word:
            # The last id of a piece, and no other, stands for letters with the suffix.
            vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            letters = pre_tokenizers.ByteLevel.alphabet()
            self.by_word = all(c in vocabulary and c + suffix in vocabulary for c in letters)
        self.pieces = pa.array([], pa.large_string())
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.stream = np.zeros(0, dtype=np.uint32)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        out = [
            np.array([*self.ids(t), end_id], dtype=np.uint32) if not self.by_word or "<|" in t else None
            for t in texts
        ]
        rest = [i for i, ids in enumerate(out) if ids is None]
        if not rest:
            return out
        joined = pc.replace_substring(pa.array([texts[i] for i in rest], pa.large_string()), "\n", " ")
        lists = pc.split_pattern(pc.ascii_lower(joined), " ")
        flat = lists.flatten().dictionary_encode()
        ids, counts = self._words(flat.dictionary)
        words = flat.indices.to_numpy()
        lengths = counts[words]
        stream = ids[_ranges((np.cumsum(counts) - counts)[words], lengths)]
        ends = np.cumsum(lengths)
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        for i, a, b in zip(rest, bounds[:-1].tolist(), bounds[1:].tolist()):
            out[i] = np.append(stream[a:b], np.uint32(end_id))
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one behind the other, and the number of each."""
        stems, tails = _stems_and_tails(words)
        both = pa.concat_arrays([stems, tails]).dictionary_encode()
        places = self._places(both.dictionary)[both.indices.to_numpy()].reshape(2, -1)
        lengths = self.lengths[places]
        return self.stream[_ranges(self.starts[places].T.ravel(), lengths.T.ravel())], lengths.sum(axis=0)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where starts and lengths have each piece; missing ones are tokenised first."""
        if len(self.pieces) > CACHE_WORDS:
            self._forget()
        places = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)
        plain = pc.match_substring_regex(pieces, f"^([{_LETTERS}]+|[{_MARKS}]+)$").to_numpy(False)
        for some, tokenise in ((plain, self._plain_ids), (~plain, self._other_ids)):
            at = np.flatnonzero((places < 0) & some)
            missing = pieces.take(pa.array(at))
            ids, counts = tokenise(missing.to_pylist())
            places[at] = len(self.pieces) + np.arange(len(at))
            self.starts = np.concatenate([self.starts, len(self.stream) + np.cumsum(counts) - counts])
            self.lengths = np.concatenate([self.lengths, counts])
            self.stream = np.concatenate([self.stream, ids])
            self.pieces = pa.concat_arrays([self.pieces, missing])
        return places

    def _forget(self) -> None:
        """Drop what came after the first CACHE_WORDS pieces."""
        self.pieces = self.pieces[:CACHE_WORDS]
        self.starts, self.lengths = self.starts[:CACHE_WORDS], self.lengths[:CACHE_WORDS]
        self.stream = self.stream[: int(self.starts[-1] + self.lengths[-1])]

    def _plain_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are letters only or marks only, and the number of each."""
        found = [np.zeros(0, dtype=np.uint32)]
        for i in range(0, len(pieces), 100):
            (some,) = self.plain.encode_batch_fast([" ".join(pieces[i : i + 100])], add_special_tokens=False)
            found.append(np.array(some.ids, dtype=np.uint32))
        ids = np.concatenate(found)
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != len(pieces):
            raise ValueError("the tokenizer parted a run of letters or of marks")
        return ids, np.diff(ends, prepend=-1)

    def _other_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words, and the number of each."""
        found = {w: np.array(self.ids(w), dtype=np.uint32) for w in words if not w or self.parter in w}
        rest = [w for w in words if w not in found]
        for i in range(0, len(rest), 100):
            found |= zip(rest[i : i + 100], self._several(rest[i : i + 100]))
        counts = np.fromiter((len(found[w]) for w in words), dtype=np.int64, count=len(words))
        return np.concatenate([np.zeros(0, dtype=np.uint32), *[found[w] for w in words]]), counts

    def _several(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words tokenised in one go, with a parter behind each that is then cut out."""
        (mark,) = self.ids(self.parter)
        text = "".join(f"{w} {self.parter} " for w in words)
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(found.ids, dtype=np.uint32)
        at = np.flatnonzero(ids == mark)
        if len(at) != len(words):
            raise ValueError("the tokenizer gave the parting letter's id to another word")
        return [part[:-1] for part in np.split(ids, at + 1)[:-1]]


def _stems_and_tails(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The plain letters and the marks behind them; any other word is a stem without marks."""
    stems = pc.ascii_rtrim(words, characters=punctuation)
    stems = pc.if_else(pc.match_substring_regex(stems, f"^[{_LETTERS}]*$"), stems, words)
    sizes = pc.binary_length(stems).to_numpy()
    lengths = pc.binary_length(words).to_numpy() - sizes
    _, offsets, data = words.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words)]
    marks = np.frombuffer(data or b"", dtype=np.uint8)[_ranges(starts + sizes, lengths)]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return stems, pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(bounds), pa.py_buffer(marks))


def split_words(path: str) -> bool:
    """Whether the tokenizer drops white space between pieces it tokenises alone."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    steps = (model.get("pre_tokenizer") or {}).get("pretokenizers", [])
    parts = [s for s in steps if s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert")]
    normal = (model.get("normalizer") or {}).get("normalizers", [])
    return (
        any(r"[^\s" in s["pattern"].get("Regex", "") for s in parts)
        and any(n.get("type") == "Lowercase" for n in normal)
        and bool(model["model"].get("end_of_word_suffix"))
    )


_WORKER: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _WORKER:
        _WORKER[path] = WordTokenizer(path)
    return _WORKER[path]


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about BATCH_CHARS bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    group = (np.cumsum(sizes) - sizes) // BATCH_CHARS
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield batch.slice(a, b - a)


def _encode_partition(path: str, end_id: int):
    """One range of documents, in order, to its blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        held = number = 0
        shard = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            shard = batch.column("shard")[0].as_py()
            for some in _portions(batch):
                texts = some.column("text").fill_null("").to_pylist()
                for doc_id, tokens in zip(some.column("doc_id").to_pylist(), tokenizer.encode(texts, end_id)):
                    ids.append(doc_id)
                    parts.append(tokens)
                    held += len(tokens)
                    if held >= BLOCK_TOKENS:
                        yield _block(shard, number, ids, parts)
                        ids, parts, held, number = [], [], 0, number + 1
        if ids:
            yield _block(shard, number, ids, parts)

    return rows


def _block(shard: int, number: int, ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
    tokens = np.concatenate(parts)
    words, offsets = encode_block(tokens)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard], pa.int32()),
            pa.array([number], pa.int32()),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
            pa.array([len(tokens)], pa.int64()),
            pa.array([offsets.tolist()], pa.list_(pa.int32())),
            pa.array([words.astype("<u8").tobytes()], pa.binary()),
        ],
        names=["shard", "block", "doc_ids", "lengths", "n_tokens", "offsets", "words"],
    )


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None) -> None:
    """Tokenise whole texts and write them in ascending order of doc_id."""
    spark = docs.sparkSession
    # Each range gets about what a task reads of the input.
    n = shards or max(docs.select("text").rdd.getNumPartitions(), 1)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    numbered = ordered.withColumn("shard", F.spark_partition_id())
    numbered.mapInArrow(_encode_partition(tokenizer, end_id), BLOCK_SCHEMA).write.mode("overwrite").parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            words = np.frombuffer(row["words"], dtype="<u8")
            tokens = decode_block(words, np.array(row["offsets"], dtype=np.int64), row["n_tokens"]).astype("<u4")
            bounds = np.concatenate([[0], np.cumsum(row["lengths"])])
            buffer = memoryview(tokens.tobytes())
            n = len(row["doc_ids"])
            crc = [zlib.crc32(buffer[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * n, pa.int32()),
                    pa.array([row["block"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(bounds[:-1], pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """Rows (shard, block, base): ids before each block. Blocks add up per shard, then shards among each other."""
    sizes = spark.read.parquet(path).select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("shard_base"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.select("shard", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("before"))
    return within.join(shards, "shard").select(
        "shard", "block", (F.col("shard_base") + F.col("before")).alias("base")
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) decoded from the files."""
    decoded = spark.read.parquet(path).mapInArrow(
        _decode, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    starts = written(block_starts(spark, path), "token-starts")
    return decoded.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
