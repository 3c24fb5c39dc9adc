"""Content-addressed store of token ids.

Layout under a folder: `parts/kind=chunk` (hash, n, body) holds each distinct chunk once, `recipes` holds one row per document in
ascending identifier order (part, pos, doc_id, n_tokens, chunk hashes, chunk lengths, Merkle root over the hashes), and
`manifest` holds, for each recipe file, the root of a Merkle tree over its recipes' roots (4,096 to a node) with the file's numbers of
documents, tokens and chunks, and, with part -1, the root over the files. Bodies are little-endian unsigned 16-bit ids where the
vocabulary allows, else 32-bit.

Chunks end where a rolling hash over the last ids has its low bits zero, so equal passages cut alike wherever they
stand in a document. A task sends each distinct chunk once, dealt by its hash; recipes are dealt by identifier. Reading back
checks the recipes against the manifest up to the top root, takes the checksum of each stored chunk, checks its hash, and
combines the checksums along each recipe: token ids are shuffled once in all. A lost or altered file is an error, never a shorter answer.

Edge cases: null and empty texts hold the end id alone; equal rows share their chunks and keep a recipe each; rows with the
same identifier, null ones first of all, keep recipes next to each other in the order of their content; an empty table gives an empty store.
"""

from __future__ import annotations

from functools import cache
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import join_salted, scratch_path, shuffle_partitions
from spanloom.llm.word_ids import encoder

TOKENIZER, END_ID = "word_bpe_49k.json", 2
WINDOW, MASK, SHORTEST, LONGEST = 8, 255, 64, 2048
_HASH = 16
BATCH = 512  # documents encoded between two outputs of a task
SENT = 1 << 20  # chunks that a task remembers as sent


def _gear(ids: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mix of each id (the finaliser of splitmix64)."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GEAR = _gear(np.arange(1 << 16))


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream: content-defined, SHORTEST to LONGEST ids each (the last may be shorter)."""
    n = len(ids)
    if n <= SHORTEST:
        return [n] if n else []
    g = _GEAR[ids] if ids.max() < len(_GEAR) else _gear(ids)
    h, k = g, 1
    while k < WINDOW:  # sums over 1, 2, 4, ... ids: each is two of the last kind
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint64(k)
        h, k = wider, 2 * k
    marks = np.flatnonzero((h >> np.uint64(20)) & np.uint64(MASK) == 0) + 1
    ends, at, m = [], 0, 0
    while n - at > SHORTEST:
        m = int(np.searchsorted(marks, at + SHORTEST))
        end = min(int(marks[m]) if m < len(marks) else n, at + LONGEST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of BLAKE2b-128 over the leaves; an odd node goes up as it is."""
    level = leaves or [b"\0" * _HASH]
    while len(level) > 1:
        level = [blake2b(b"".join(level[i : i + 2]), digest_size=_HASH).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _split(tokenizer: str, end_id: int):
    def run(batches):
        words, sent, part, row = encoder(tokenizer), set(), TaskContext.get().partitionId(), 0
        narrow = words.library.get_vocab_size() <= 1 << 16
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.frombuffer(words.encode(text) + end, dtype="<u4")
                raw = ids.astype("<u2").tobytes() if narrow else ids.tobytes()
                width, at, names, sizes = 2 if narrow else 4, 0, [], []
                for stop in cut_points(ids):
                    body = raw[at * width : stop * width]
                    name = blake2b(body, digest_size=_HASH).digest()
                    names.append(name)
                    sizes.append(stop - at)
                    if name not in sent:
                        sent.add(name)
                        rows.append(("chunk", int.from_bytes(name[:8], "little", signed=True), None, stop - at, name, body, None))
                    at = stop
                row += 1  # recipes are dealt by where they come from, so equal ones, whatever their number, spread
                rows.append(("doc", crc32(b"%d %d" % (part, row)), doc, len(ids), b"".join(names), None, sizes))
            if len(sent) > SENT:
                sent.clear()  # a chunk may be sent again; `_once` keeps one
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.string(), pa.int64(), batch.schema.field("doc_id").type, pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "deal", "doc_id", "n", "name", "body", "sizes"])

    return run


def _once(batches):
    """Of the rows of a partition, every recipe and the first row of each chunk; a partition holds all rows of its chunks."""
    seen = set()
    for batch in batches:
        recipe = pc.equal(batch.column("kind"), "doc").to_pylist()
        keep = list(recipe)
        for i, (doc, name) in enumerate(zip(recipe, batch.column("name").to_pylist())):
            if not doc and name not in seen:
                seen.add(name)
                keep[i] = True
        yield batch if all(keep) else batch.filter(pa.array(keep, pa.bool_()))


def _number(batches):
    """Recipes of a partition in order: their place in it and the Merkle root of each."""
    part, pos = TaskContext.get().partitionId(), 0
    for batch in batches:
        roots = [merkle([x[i : i + _HASH] for i in range(0, len(x), _HASH)]) for x in batch.column("name").to_pylist()]
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(pos, pos + n)), *(batch.column(c) for c in ("doc_id", "n", "name", "sizes")), pa.array(roots, pa.binary())],
            names=["part", "pos", "doc_id", "n_tokens", "chunks", "sizes", "root"],
        )
        pos += n


def write_store(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Encode whole texts and write them to `folder`."""
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    row = f"kind string, deal long, doc_id {kind}, n long, name binary, body binary, sizes array<int>"
    rows = docs.mapInArrow(_split(tokenizer, end_id), row)
    rows.repartition(n, "deal").mapInArrow(_once, row).drop("deal").write.partitionBy("kind").parquet(f"{folder}/parts")
    plain = spark.read.schema(f"doc_id {kind}, n long, name binary, body binary, sizes array<int>, kind string").parquet(f"{folder}/parts")
    recipes = plain.where("kind = 'doc'").select("doc_id", "n", "name", "sizes", F.xxhash64("name").alias("tie"))
    # rows that are equal in all, of which there may be many, are told apart by their place in the files, so that ranges can cut them
    recipes = recipes.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, "doc_id", "tie", "place")
    recipes = recipes.sortWithinPartitions("doc_id", "tie", "name").drop("tie", "place")
    recipe = f"part int, pos long, doc_id {kind}, n_tokens long, chunks binary, sizes array<int>, root binary"
    recipes.mapInArrow(_number, recipe).write.parquet(f"{folder}/recipes")
    # roots of a file, by position, are read in Spark a file at a time; the driver sees one root a file
    files = _file_roots(spark.read.schema(recipe).parquet(f"{folder}/recipes")).collect()
    rows = [(r["part"], r["documents"], r["n_tokens"], r["n_chunks"], bytes(r["root"])) for r in files]
    rows.append((-1, *(sum(r[k] for r in rows) for k in (1, 2, 3)), _top(files)))
    spark.createDataFrame(rows, "part int, documents long, n_tokens long, n_chunks long, root binary").coalesce(1).write.parquet(f"{folder}/manifest")


def _top(files: list) -> bytes:
    return merkle([bytes(r["root"]) for r in sorted(files, key=lambda r: r["part"])])


def _file_roots(recipes: DataFrame) -> DataFrame:
    """Root over the recipe roots of each file: blocks of 4,096 first, then over the blocks in order."""
    order = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda y: F.hex(y["root"])), "")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_chunks")]
    rows = recipes.select("part", "pos", "root", "n_tokens", F.size("sizes").alias("n_chunks"))
    blocks = rows.groupBy("part", F.floor(F.col("pos") / 4096).alias("block")).agg(order(F.struct("pos", "root")).alias("all"), F.count(F.lit(1)).alias("documents"), *sums)
    blocks = blocks.select("part", "block", F.unhex(F.sha2("all", 256)).alias("root"), "documents", "n_tokens", "n_chunks")
    files = blocks.groupBy("part").agg(order(F.struct("block", "root")).alias("all"), F.sum("documents").alias("documents"), *sums)
    return files.select("part", F.unhex(F.sha2("all", 256)).alias("root"), "documents", "n_tokens", "n_chunks")


def _checksums(batches):
    for batch in batches:
        names, crcs, fine = batch.column("name").to_pylist(), [], []
        for name, n, body in zip(names, batch.column("n").to_pylist(), batch.column("body").to_pylist()):
            ids = np.frombuffer(body, dtype="<u2" if len(body) == 2 * n else "<u4")
            crcs.append(crc32(ids.astype("<u4").tobytes()))
            fine.append(len(ids) == n and blake2b(body, digest_size=_HASH).digest() == name)
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("n"), pa.array(crcs, pa.int64()), pa.array(fine, pa.bool_())], names=["name", "n", "crc", "fine"])


def _square(m: list[int]) -> list[int]:
    return [_times(m, x) for x in m]


def _times(m: list[int], v: int) -> int:
    out = i = 0
    while v:
        if v & 1:
            out ^= m[i]
        v >>= 1
        i += 1
    return out


class CrcJoin:
    """CRC-32 of a concatenation from the parts' values: appending 2^k zero bytes is a linear map over bits, held as byte tables."""

    def __init__(self):
        one_bit = [0xEDB88320, *(1 << i for i in range(31))]
        m = _square(_square(_square(one_bit)))  # one byte
        self.tables = []
        for _ in range(40):
            tables = []
            for k in range(4):
                t = [0] * 256
                for b in range(1, 256):  # linear: the lowest bit's column and the rest
                    t[b] = t[b & (b - 1)] ^ m[8 * k + (b & -b).bit_length() - 1]
                tables.append(t)
            self.tables.append(tables)
            m = _square(m)

    def join(self, crc: int, more: int, n_bytes: int) -> int:
        k = 0
        while n_bytes:
            if n_bytes & 1:
                a, b, c, d = self.tables[k]
                crc = a[crc & 255] ^ b[crc >> 8 & 255] ^ c[crc >> 16 & 255] ^ d[crc >> 24]
            n_bytes >>= 1
            k += 1
        return crc ^ more


@cache
def _joiner() -> CrcJoin:
    return CrcJoin()


def _rebuild(batches):
    joiner = _joiner()
    for batch in batches:
        crcs, tokens, fine, at = [], [], [], 0
        parts = batch.column("parts")
        _, names, sizes, sums, good = parts.flatten().flatten()  # k, name, n, crc, fine of all documents, one after another
        names, sizes, sums, good = names.to_pylist(), sizes.fill_null(0).to_pylist(), sums.fill_null(0).to_pylist(), good.fill_null(False).to_pylist()
        for count, root, want in zip(parts.value_lengths().to_pylist(), *(batch.column(c).to_pylist() for c in ("root", "n_tokens"))):
            end = at + count
            whole, crc, n = all(good[at:end]), 0, 0  # a chunk that is not there isn't good
            for more, ids in zip(sums[at:end], sizes[at:end]) if whole else ():
                crc = joiner.join(crc, more, 4 * ids) if n else more
                n += ids
            crcs.append(crc)
            tokens.append(n)
            fine.append(whole and n == want and merkle(names[at:end]) == root)
            at = end
        cols = [batch.column(c) for c in ("part", "pos", "doc_id")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(tokens, pa.int64()), pa.array(crcs, pa.int64()), pa.array(fine, pa.bool_())], names=["part", "pos", "doc_id", "n_tokens", "ids_crc32", "verified"])


def _checked(recipes: DataFrame, manifest: DataFrame) -> dict:
    """The manifest's rows by file, once the recipes that are there agree with it, file by file and at the top."""
    rows = {r["part"]: r for r in manifest.collect()}  # a row a file
    top, files = rows.pop(-1, None), _file_roots(recipes).collect()
    if top is None or _top(list(rows.values())) != bytes(top["root"]):
        raise ValueError("the manifest is incomplete or altered")
    there = {r["part"]: bytes(r["root"]) for r in files}
    wrong = sorted(p for p in rows.keys() | there.keys() if p not in rows or there.get(p) != bytes(rows[p]["root"]))
    if wrong:
        raise ValueError(f"recipe files {wrong[:20]} are missing or differ from the manifest")
    return rows


def _frequent(recipes: DataFrame, uses: int, sample: int = 200_000, most: int = 1_000) -> DataFrame:
    """(name, parts) of the chunks used so often that they are dealt over several tasks, as a sample of the recipes shows them. It decides
    where rows meet, never which; at most about `most` names can reach their share of the sample."""
    share = min(1.0, sample / max(1, uses))
    least = max(20.0, uses * share / most)
    names = recipes.sample(share, 1).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("sizes") - 1), lambda k: F.substring("chunks", k * _HASH + 1, F.lit(_HASH)))).alias("name"))
    counted = names.groupBy("name").agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") > least)
    return counted.select("name", F.ceil(F.col("uses") / least).alias("parts"))


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document read back: doc_id, start, n_tokens, ids_crc32, verified. An error names what a store lacks: here for
    recipes and the manifest, in the job that reads the rows for a chunk that is lost or altered."""
    recipes = spark.read.parquet(f"{folder}/recipes")
    files = _checked(recipes, spark.read.parquet(f"{folder}/manifest"))
    before, bases = 0, []
    for part in sorted(files):
        bases.append((part, before))
        before += files[part]["n_tokens"]
    store = spark.read.schema("name binary, n long, body binary, kind string").parquet(f"{folder}/parts").where("kind = 'chunk'").select("name", "n", "body")
    checks = store.mapInArrow(_checksums, "name binary, n long, crc long, fine boolean")
    one = recipes.select("part", "pos", F.explode(F.sequence(F.lit(0), F.size("sizes") - 1)).alias("k"), "chunks").select("part", "pos", "k", F.expr(f"substring(chunks, k * {_HASH} + 1, {_HASH})").alias("name"))
    held = join_salted(one, checks, "name", _frequent(recipes, sum(f["n_chunks"] for f in files.values())), F.xxhash64("part", "pos", "k"), "left")
    held = held.select("part", "pos", F.struct("k", "name", "n", "crc", "fine").alias("p"))
    found = held.groupBy("part", "pos").agg(F.array_sort(F.collect_list("p")).alias("parts"))
    kind = recipes.schema["doc_id"].dataType.simpleString()
    whole = recipes.select("part", "pos", "doc_id", "n_tokens", "root").join(found, ["part", "pos"])
    docs = whole.mapInArrow(_rebuild, f"part int, pos long, doc_id {kind}, n_tokens long, ids_crc32 long, verified boolean")
    earlier = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    offset = spark.createDataFrame(bases, "part int, base long")  # a row per file
    placed = docs.withColumn("inside", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    lost = F.raise_error(F.concat(F.lit("a chunk of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" is missing or altered")))
    return placed.join(F.broadcast(offset), "part").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", F.when(F.col("verified"), F.col("ids_crc32")).otherwise(lost.cast("long")).alias("ids_crc32"), "verified")


def store_documents(df: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write df's texts to a store (by default in the shared folder) and return what reading it back gives."""
    folder = folder or scratch_path(df.sparkSession, "token-store")
    write_store(df, folder, **options)
    return read_store(df.sparkSession, folder)
