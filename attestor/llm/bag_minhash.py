"""Near-duplicate detection with BagMinHash over bags of five-word shingles.

A shingle that occurs w times in a text owns the weight levels 1 to w. The levels are cut into the dyadic
ranges (0, 1], (1, 2], (2, 4], ...; each is the root of a hierarchy of Poisson processes, seeded by shingle and
range alone, whose rate is the range's length. A process of several levels passes its first point on to one of
its halves and starts the other half's process after it; halves beyond the text's weight are dropped, and a
single level's process bids with its points for registers of the signature, which keep their earliest. Processes
wait until their text's horizon reaches them and end at its latest register, so a weight costs its logarithm.
Two signatures agree in a register with probability equal to the texts' weighted Jaccard similarity.

Registers are banded. Texts in a bucket are compared exactly with the bucket's leader, and those that are
not near it with all others that share this leader and may be near them by the triangle inequality, in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.components import components
from attestor.llm.shingles import Powers, mix, shingle_bags
from attestor.llm.tables import by_size, content, discard, fitting, in_small_batches, keep_rows, settle

WORDS, THRESHOLD = 5, 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8 ** 4) ** 25, 2e-6.
BANDS, ROWS = 25, 4
BATCH_BYTES = 1 << 20
POINTS = 200_000
#: Texts in a block of a leader's group; columns of a product of rows.
BLOCK, COLUMNS = 128, 2048
HOT = 512


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _draw(seed: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix(seed + (number + np.uint64(1)) * _GOLDEN)


def _gap(bits: np.ndarray) -> np.ndarray:
    """An exponential variate of rate 1."""
    return -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


class Processes:
    """Poisson processes: the text, its weight of the shingle, the range (low, high] of levels, the seed, the time of the
    next point and that point's number."""

    def __init__(self, *columns: np.ndarray):
        self.columns = columns
        self.text, self.weight, self.low, self.high, self.seed, self.at, self.n = columns

    def where(self, chosen: np.ndarray) -> Processes:
        return Processes(*(x[chosen] for x in self.columns))

    @staticmethod
    def joined(parts: list[Processes]) -> Processes:
        return Processes(*(np.concatenate(x) for x in zip(*(p.columns for p in parts), strict=True)))

    @staticmethod
    def roots(text: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> Processes:
        parts, k, top = [], 0, int(count.max(initial=0))
        while k == 0 or 1 << (k - 1) < top:
            low, high = (1 << k - 1 if k else 0), 1 << k
            has = np.flatnonzero(count > low)
            seed = mix(shingle[has] + np.uint64((k * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) & (2**64 - 1)))
            first = _gap(_draw(seed, np.zeros(len(has), np.uint64))) / (high - low)
            parts.append(Processes(text[has], count[has], np.full(len(has), low), np.full(len(has), high), seed, first, np.zeros(len(has), np.uint64)))
            k += 1
        return Processes.joined(parts)

    def halves(self) -> Processes:
        """The processes of both halves, as far as the text's weight reaches into them."""
        middle = (self.low + self.high) // 2
        below = (_draw(self.seed, np.full(len(self.seed), 1 << 62, np.uint64)) & np.uint64(1)) == 0
        parts = []
        for low, high, salt, inherits in ((self.low, middle, 0x8CB92BA72F3D8DD7, below), (middle, self.high, 0x2127599BF4325C37, ~below)):
            seed = mix(self.seed ^ np.uint64(salt))
            number = np.zeros(len(seed), np.uint64)
            at = np.where(inherits, self.at, self.at + _gap(_draw(seed, number)) / (high - low))
            parts.append(Processes(self.text, self.weight, low, high, seed, at, number).where(self.weight > low))
        return Processes.joined(parts)


def signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """Of each text, the identity of the earliest point in each register."""
    best = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    # about as long as the latest register takes
    horizon = 2 * registers * (np.log(registers) + 1) / np.maximum(1, np.bincount(text, count, texts))
    with np.errstate(over="ignore"):
        queue = Processes.roots(text, shingle, count)
        while len(queue.text):
            queue = queue.where(queue.at < best.reshape(texts, registers).max(1)[queue.text])
            ready = queue.at <= horizon[queue.text]
            if not ready.any():
                horizon[queue.text] = 2 * horizon[queue.text]
                continue
            single = queue.high - queue.low == 1
            p = queue.where(ready & single)
            parts = [queue.where(~ready), queue.where(ready & ~single).halves()]
            if len(p.text):
                points = max(1, min(64, POINTS // len(p.text)))
                number = p.n[:, None] + np.arange(points + 1, dtype=np.uint64)
                bits = _draw(p.seed[:, None], number)
                when = p.at[:, None] + np.concatenate((np.zeros((len(p.text), 1)), np.cumsum(_gap(bits[:, 1:]), 1)), 1)
                early, bits = when[:, :-1].ravel(), mix(bits[:, :-1] ^ _GOLDEN).ravel()
                register = np.repeat(p.text * registers, points) + ((bits >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
                np.minimum.at(best, register, early)
                won = best[register] == early
                winner[register[won]] = bits[won]
                parts.append(Processes(p.text, p.weight, p.low, p.high, p.seed, when[:, -1], p.n + np.uint64(points)))
            queue = Processes.joined(parts)
    return winner.reshape(texts, registers)


def band_keys(winners: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.zeros((len(winners), bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            keys = keys * np.uint64(0xD1342543DE82EF95) + winners.reshape(len(winners), bands, rows)[:, :, r]
        return mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _digests(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: list[bytes | None]) -> list[str]:
    """Equal for equal bags; a text without words has the digest of its bytes."""
    with np.errstate(over="ignore"):
        sums = [np.zeros(len(texts), np.uint64) for _ in range(2)]
        for s, salt in zip(sums, (0x8CB92BA72F3D8DD7, 0x2127599BF4325C37), strict=True):
            np.add.at(s, text, mix(shingle ^ np.uint64(salt)) * count.astype(np.uint64))
    size = np.bincount(text, count, len(texts)).astype(np.int64)
    return [f"{a:016x}{b:016x}{n:x}" if n else hashlib.md5(t or b"").hexdigest() for a, b, n, t in zip(*(s.tolist() for s in sums), size.tolist(), texts, strict=True)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in by_size(batches, "text", BATCH_BYTES):
        texts = batch.column("text").to_pylist()
        with np.errstate(over="ignore"):
            of, shingle, count = shingle_bags(texts, WORDS, powers)
            keys = band_keys(signatures(of, shingle, count, len(texts)))
        some = np.bincount(of, minlength=len(texts)) > 0
        bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * BANDS))), pa.int32()), pa.array(keys[some].ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), batch.column("row"), pa.array(_digests(of, shingle, count, texts)), bands], ["doc_id", "content", "row", "digest", "bands"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted shingles, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return both / max(1, a[1].sum() + b[1].sum() - both)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each member with the leader row that comes before it."""
    powers = Powers()
    first: tuple[np.ndarray, np.ndarray] | None = None
    for batch in by_size(batches, "text", BATCH_BYTES):
        with np.errstate(over="ignore"):
            of, shingle, count = shingle_bags(batch.column("text").to_pylist(), WORDS, powers)
        cut = np.searchsorted(of, np.arange(batch.num_rows + 1))
        leaders, nodes, found, weights = [], [], [], []
        for i, (leader, member, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("leader", "member", "id")), strict=True)):
            bag = shingle[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]]
            if not member:
                first = bag
            else:
                leaders.append(leader)
                nodes.append(node)
                found.append(float(similarity(first, bag)))
                weights.append(int(bag[1].sum()))
        yield pa.RecordBatch.from_arrays([pa.array(leaders, pa.int64()), pa.array(nodes, pa.int64()), pa.array(found, pa.float64()), pa.array(weights, pa.int64())], ["leader", "node", "similarity", "weight"])


def _links_of_block(threshold: float):
    """Links between texts of two blocks (or one) of a group, of which at least one is not near the group's leader.

    Overlaps come from products of the texts' 0/1 rows over the elements (shingle, number of its occurrence)
    that several texts have. Of the links only a spanning forest is returned: the classes need no more.
    """

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        rows = sorted(part.select(["node", "open", "block", "text"]).to_pylist(), key=lambda r: r["node"])
        rows = [r for r, before in zip(rows, [None, *rows], strict=False) if before is None or r["node"] != before["node"]]
        with np.errstate(over="ignore"):
            of, shingle, count = shingle_bags([r["text"] for r in rows], WORDS, Powers())
            sizes = np.bincount(of, count, len(rows))
            number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            element, of = mix(np.repeat(shingle, count) + mix(number.astype(np.uint64))), np.repeat(of, count)
        _, column, held = np.unique(element, return_inverse=True, return_counts=True)
        several = held[column] > 1
        of, column = of[several], np.unique(column[several], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        of, column = of[order], column[order]
        both = np.zeros((len(rows), len(rows)), np.float32)
        for first in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
            a, b = np.searchsorted(column, (first, first + COLUMNS))
            has = np.zeros((len(rows), COLUMNS), np.float32)
            has[of[a:b], column[a:b] - first] = 1
            both += has @ has.T
        near = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6
        near &= both > 0
        is_open, block = np.array([r["open"] for r in rows]), np.array([r["block"] for r in rows])
        near &= is_open[:, None] | is_open[None, :]
        if key[1].as_py() != key[2].as_py():
            near &= block[:, None] != block[None, :]
        root = list(range(len(rows)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((rows[i]["node"], rows[j]["node"]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _meetings(scored: DataFrame, threshold: float) -> DataFrame:
    """(leader, low, high, node, open, block): which members of a leader's group (leader, node, similarity, weight) meet.

    Only members that are not near the leader, the open ones, still need others. The distance 1 - similarity obeys
    the triangle inequality, so a member much nearer to the leader than any open one is near none of these, nor is
    one of a very different weight. Blocks of open members meet each other and those of the remaining members, which
    do not meet among themselves: beside one block of open members, rows grow in step with the group.
    """
    members = scored.withColumn("open", F.col("similarity") < threshold)
    of_open = lambda value: F.when(F.col("open"), F.col(value))
    reach = members.groupBy("leader").agg(F.max(of_open("similarity")).alias("nearest"), F.min(of_open("weight")).alias("lightest"), F.max(of_open("weight")).alias("heaviest")).where("nearest IS NOT NULL")
    slack = 1e-9
    left = members.join(reach, "leader").where(F.col("open") | ((F.col("similarity") <= F.col("nearest") + (1 - threshold) + slack) & F.col("weight").between(F.col("lightest") * threshold - slack, F.col("heaviest") / threshold + slack)))
    sizes = left.groupBy("leader").agg(F.count_if("open").alias("opened"), F.count_if(~F.col("open")).alias("others")).where("opened + others > 1")
    blocks = sizes.select("leader", F.ceil(F.col("opened") / BLOCK).alias("a"), F.ceil(F.col("others") / BLOCK).alias("b"))
    dealt = left.join(blocks, "leader").withColumn("block", F.when(F.col("open"), F.pmod(F.xxhash64("node"), F.col("a"))).otherwise(F.col("a") + F.pmod(F.xxhash64("node"), F.greatest("b", F.lit(1)))))
    last = F.when(F.col("open"), F.col("a") + F.col("b")).otherwise(F.col("a")).cast("int") - 1
    one = F.transform(F.sequence(F.lit(0), last), lambda other: F.struct(F.least("block", other).alias("low"), F.greatest("block", other).alias("high")))
    return dealt.withColumn("meeting", F.explode(one)).select("leader", "meeting.low", "meeting.high", "node", "open", "block")


def _links(buckets: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect all texts near each other that share a bucket, from buckets (key, n, node).

    The leader of a bucket is the text that shares most buckets with others, which stands in the middle of
    its kind. Texts that share a bucket share its leader, so a leader's group has all their pairs. Each text
    is compared with its leaders, of whose text each block of BLOCK members gets one copy; those that are not
    near one meet others of its group by _meetings, so that no task holds a group and no pairs are listed.
    """
    popular = buckets.groupBy("node").agg(F.sum("n").alias("mates"))
    ranked = buckets.join(popular, "node")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("mates", (-F.col("node")).alias("minus"))).alias("best")).select("key", (-F.col("best.minus")).alias("leader"))
    leaders = settle(leaders, "leaders", narrow=True)
    groups = settle(buckets.join(fitting(leaders), "key").where("node <> leader").select("leader", "node").distinct(), "groups", narrow=True)
    parts = groups.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = groups.join(parts, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), F.lit(1).alias("member"), F.col("node").alias("id"))
    heads = parts.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"), F.col("leader").alias("id"))
    sided = dealt.unionByName(heads).join(texts, "id").repartition("leader", "part").sortWithinPartitions("leader", "part", "member")
    scored = settle(sided.select("leader", "member", "id", "text").mapInArrow(_compare, "leader long, node long, similarity double, weight long"), "scored", narrow=True)
    near = scored.where(F.col("similarity") >= threshold).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    met = _meetings(scored, threshold)
    inner = met.join(texts.withColumnRenamed("id", "node"), "node").groupBy("leader", "low", "high").applyInArrow(_links_of_block(threshold), "a long, b long")
    return near.unionByName(inner).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _decide(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(doc_id, content, class_id, kept) of each row; of each class one row is kept."""
    named = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), content(F.col(text_col)).alias("content"), F.col(text_col).cast("binary").alias("text"))
    source = named.select("*", F.monotonically_increasing_id().alias("row"))
    signed = settle(source.mapInArrow(_sign, "doc_id long, content string, row long, digest string, bands array<long>"), "signed")
    # a node is a bag, numbered once the table is written
    bags = signed.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row", "content")).alias("first"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    firsts = settle(bags.select("digest", "first", "bands", "n", F.monotonically_increasing_id().alias("node")), "firsts")
    bands = settle(firsts.select(F.explode("bands").alias("key"), "node"), "bands", narrow=True)
    shared = settle(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared", narrow=True)
    buckets = settle(bands.join(fitting(shared), "key").select("key", "n", "node"), "buckets", narrow=True)
    discard(bands)
    nodes = settle(firsts.join(buckets.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("id"), F.col("first.doc_id").alias("of_id"), F.col("first.content").alias("of_content")), "nodes", narrow=True)
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("content") == F.col("of_content"))
    # rows that repeat an id and a text have one text: any of them will do
    found = named.join(fitting(nodes), same).groupBy("id").agg(F.first("text").alias("text"))
    texts = settle(found, "texts")
    links = settle(_links(buckets, texts, threshold), "links", narrow=True)
    discard(texts)
    labels = components(links)
    labelled = firsts.join(labels, "node").select("digest", "label", "first")
    heads = labelled.groupBy("label").agg(F.min("first").alias("head"))
    classes = firsts.select("digest", "first", "n").join(labelled.join(heads, "label").select("digest", "head"), "digest", "left").select("digest", F.coalesce("head", "first").alias("head"), "n")
    # bags that more than 1/HOT of the rows share, fewer than HOT, are broadcast, so that no task gets all rows of one
    rows = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(classes.where(F.col("n") * HOT > rows).drop("n"))
    members = signed.select("doc_id", "content", "row", "digest")
    out = members.join(hot, "digest").unionByName(members.join(hot, "digest", "left_anti").join(classes.drop("n"), "digest"))
    return out.select("doc_id", "content", F.col("head.doc_id").alias("class_id"), (F.col("row") == F.col("head.row")).alias("kept"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, kept.

    A class is what chains of near duplicates connect; class_id is its smallest id, and of its rows that of the
    smallest id is kept, one of them where several tie. Texts of equal bags are copies; a text of one to four words
    is a single shingle, and texts without words are copies only of themselves. A null text is empty; a text of any
    length is read whole. Rows of one id may have different texts: each is compared. Null ids come last; a class
    without an id has a null class_id. Other columns, whatever their names, are not read; an empty table gives an
    empty result.
    """
    return _decide(docs, id_col, text_col, threshold).select("doc_id", "class_id", "kept")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that near_duplicates keeps, one for each class, all columns as they are."""
    return keep_rows(docs, _decide(docs, id_col, text_col, threshold), id_col, text_col)


#: All pairs that share a shingle, and the closure of their links: for small tables only.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (
  SELECT doc_id, array_to_string(w[p : p + 4], ' ') AS g, count(*) AS n
  FROM t, unnest(range(1, greatest(len(w) - 3, 2))) AS u(p) WHERE len(w) > 0 GROUP BY ALL),
z AS (SELECT doc_id, sum(n) AS z FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS m FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE m >= 0.8 * (zx.z + zy.z - m)
  UNION SELECT a.doc_id, b.doc_id FROM t a JOIN t b ON a.text = b.text AND a.doc_id < b.doc_id WHERE len(a.w) = 0),
mutual AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM t UNION SELECT r.x, b.y FROM reach r JOIN mutual b ON b.x = r.y)
SELECT x AS doc_id, min(y) AS class_id, x = min(y) AS kept FROM reach GROUP BY x
"""
