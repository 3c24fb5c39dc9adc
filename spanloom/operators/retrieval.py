"""Vector retrieval, merging over probes, overlap suppression and length buckets."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.operators.intervals import keep_unless_empty, united
from spanloom.operators.ordered import ordered

PROBES = 1_000  # probes that meet the corpus at a time


def nearest(corpus: DataFrame, probes: DataFrame, k: int = 8) -> DataFrame:
    """Exact k nearest by cosine: probes (probe, embedding) are stated by the caller and meet the corpus in blocks of bounded size;
    relevance = max(0, cosine), 4 places."""
    asked = probes.select("probe", F.col("embedding").alias("q"))
    blocks = max(1, -(-asked.count() // PROBES))
    best = Window.partitionBy("probe").orderBy(F.desc("relevance"), "id")
    found = None
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("probe"), F.lit(blocks)) == number) if blocks > 1 else asked
        pairs = corpus.select("id", F.col("embedding").alias("v")).crossJoin(F.broadcast(block))  # about PROBES rows
        scored = pairs.select("probe", "id", F.round(F.greatest(F.lit(0.0), C.cosine(F.col("v"), F.col("q"))), 4).alias("relevance"))
        top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = top if found is None else united(found, top)
    return found


def search(corpus: DataFrame, probes: DataFrame, k: int = 8, most: int = 50) -> DataFrame:
    """Hits on one finished medium, k held to 1 .. `most`; corpus also has start_ms and end_ms, which come back in seconds."""
    hits = nearest(corpus, probes, min(max(int(k), 1), most))
    times = corpus.select("id", *(F.round(F.col(c) / 1000, 3).alias(n) for c, n in (("start_ms", "start"), ("end_ms", "end"))))
    return hits.join(times, "id").select("probe", "rank", "id", "relevance", "start", "end")


def merge_probes(hits: DataFrame, n_probes: int) -> DataFrame:
    """Hits of one chunk over all probes: best relevance and the distance there, number of probes, retrieval score with a bonus for breadth. Hits may bring their
    distance; without it, it follows from the relevance."""
    distance = F.col("distance") if "distance" in hits.columns else F.round(1 - F.col("relevance"), 4)
    first = F.struct(-F.col("relevance"), "probe")  # the first probe among equals
    merged = hits.withColumn("distance", distance).groupBy("id").agg(
        F.max("relevance").alias("relevance"), F.min_by("distance", first).alias("distance"), F.count(F.lit(1)).alias("match_count"), F.sort_array(F.collect_list("probe")).alias("matched")
    )
    breadth = F.least(F.col("match_count") / max(n_probes / 2, 1), F.lit(1.0))
    return merged.withColumn("retrieval_score", F.round(0.75 * F.col("relevance") + 0.25 * breadth, 4))


def retrieve(corpus: DataFrame, probes: DataFrame, limit: int = 14, per_probe: int = 6, max_overlap: float = 0.6) -> DataFrame:
    """The `limit` best chunks of each medium of the corpus (media_id, id, embedding, start_ms, end_ms) for the probes (probe, embedding), those that nearly
    repeat a better one left out: media_id, id, rank, start_ms, end_ms and what `merge_probes` says."""
    merged = merge_probes(nearest(corpus, probes, per_probe), probes.count())
    found = merged.join(corpus.drop("embedding"), "id")
    kept = suppress(found, "retrieval_score", max_overlap).where(F.col("rank") <= limit)
    return found.join(kept, ["media_id", "id"])


FOLD = 500  # candidates of a medium up to which they wait for its end and are folded


class Suppression:
    """Greedy suppression of a medium's spans as they come by start. A span waits until none that begins later can overlap it and until the better ones it clashes with are
    settled, so memory holds the spans of one moment and the chains of clashes that hang on them, whatever the medium's length."""

    def __init__(self, most: float, fold: int = FOLD):
        self.most, self.fold = most, fold
        self.held, self.open, self.count = [], [], 0

    def add(self, o, id, s, e):
        if self.held is None:
            return self._next(o, id, s, e)
        self.held.append((o, id, s, e))
        if len(self.held) <= self.fold:
            return []
        held, self.held = self.held, None
        return [x for h in held for x in self._next(*h)]

    def close(self) -> list:
        if self.held is None:
            out: list = []
            while self.open:
                self._passed(heapq.heappop(self.open)[2], out)
            return out
        kept: list = []
        for x in sorted(self.held, key=lambda h: _standing(*h[:2])):
            if not any(self._clash(*x[2:], *k[2:]) for k in kept):
                kept.append(x)
        return [(k[1], k[0]) for k in kept]

    def _clash(self, s, e, a, b) -> bool:
        """`overlap_ratio` of two spans is over the limit."""
        if s is None or e is None or a is None or b is None:
            return False
        shorter, shared = min(e - s, b - a), min(e, b) - max(s, a)
        return (max(0, shared) / shorter if shorter > 0 else 0.0) > self.most

    def _next(self, o, id, s, e) -> list:
        if s is None or e is None or e <= s:
            return [(id, o)]  # nothing overlaps it
        out: list = []
        while self.open and self.open[0][0] <= s:
            self._passed(heapq.heappop(self.open)[2], out)
        # standing, start, end, row, better ones that aren't settled, worse ones, still open, settled
        new = [_standing(o, id), s, e, (id, o), 0, [], True, False]
        for _, _, old in self.open:
            if not old[7] and self._clash(s, e, old[1], old[2]):
                better, worse = (old, new) if old[0] < new[0] else (new, old)
                better[5].append(worse)
                worse[4] += 1
        self.count += 1
        heapq.heappush(self.open, (e, self.count, new))
        return out

    def _passed(self, span: list, out: list) -> None:
        """Nothing that comes can overlap the span: if no better one is left, it stays, its worse ones go, and those that waited for these may stay."""
        span[6] = False
        stays = [] if span[7] or span[4] else [span]
        while stays:
            span = stays.pop()
            span[7] = True
            out.append(span[3])
            for gone in span[5]:
                if not gone[7]:
                    gone[7] = True
                    for waits in gone[5]:
                        waits[4] -= 1
                        if not waits[4] and not waits[6] and not waits[7]:
                            stays.append(waits)
                    gone[5] = []
            span[5] = []


def _standing(o, id) -> tuple:
    """The better span has the smaller one: negated score, none first and NaN last as Spark sorts it, then the identifier."""
    return o is not None, o != o, o, id


def suppress(rows: DataFrame, score: str, max_overlap: float = 0.5, by: str = "media_id", fold: int = FOLD) -> DataFrame:
    """Greedy suppression in falling score: a span stays unless it overlaps a kept one by more than the share of the shorter. Returns (by, id, rank).
    A medium's candidates go by once, sorted by start: those of small media are folded at its end, those of larger ones are settled as they go by."""
    spans = rows.select(by, "id", (-F.col(score)).alias("_o"), F.col("start_ms").cast("long").alias("_s"), F.col("end_ms").cast("long").alias("_e"))
    kinds = {c: spans.schema[c].dataType.simpleString() for c in ("id", "_o")}
    kept = ordered(spans, by, ["_s", "_e", "id"], ["_o", "id", "_s", "_e"], lambda: Suppression(max_overlap, fold), f"id {kinds['id']}, _o {kinds['_o']}")
    return kept.select(by, F.row_number().over(Window.partitionBy(by).orderBy("_o", "id")).alias("rank"), "id")


def select_clips(clips: DataFrame, count: int = 5, low: float = 15.0, high: float = 180.0, max_overlap: float = 0.35, spread: bool = True) -> DataFrame:
    """The final clips of each medium (media_id, id, start_ms, end_ms, score, duration in seconds): those under the least length go unless that leaves none, near
    repeats of better ones go, and what is left is spread over the lengths or taken by score. Returns media_id, rank, id."""
    long_enough = keep_unless_empty(clips.withColumn("_long", F.col("duration") >= low - 0.5), "_long").drop("_long")
    apart = suppress(long_enough, "score", max_overlap)
    left = long_enough.join(apart.select("media_id", "id"), ["media_id", "id"], "left_semi")
    if spread:
        return spread_by_duration(left, duration_buckets(clips.sparkSession, count, low, high), count)
    order = Window.partitionBy("media_id").orderBy(F.desc("score"), "id")
    return left.select("media_id", F.row_number().over(order).alias("rank"), "id").where(F.col("rank") <= count)


def duration_buckets(spark, count: int, lo: float = 15.0, hi: float = 180.0) -> DataFrame:
    """Geometric length ranges, shortest first."""
    if hi <= lo or count <= 1:
        return spark.createDataFrame([(1, lo, hi)], "bucket int, lo double, hi double")
    ratio = F.lit((hi / lo) ** (1.0 / count))
    rows = spark.range(count).select((F.col("id") + 1).cast("int").alias("bucket"), F.round(lo * F.pow(ratio, F.col("id")), 2).alias("lo"), F.when(F.col("id") == count - 1, F.lit(hi)).otherwise(F.round(lo * F.pow(ratio, F.col("id") + 1), 2)).alias("hi"))
    return rows


def length_classes(candidates: DataFrame, count: int = 5, low: float = 15.0, high: float = 180.0) -> DataFrame:
    """Candidates (media_id, id, retrieval_score, ...), best first, dealt in turn over the length ranges of their medium's clips: low_ms and high_ms."""
    turn = F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("retrieval_score"), "id"))
    classes = duration_buckets(candidates.sparkSession, count, low, high)
    ranges = classes.select("bucket", *(F.round(F.col(c) * 1000).cast("long").alias(n) for c, n in (("lo", "low_ms"), ("hi", "high_ms"))))
    numbered = candidates.withColumn("bucket", (F.pmod(turn - 1, F.lit(max(1, count if high > low else 1))) + 1).cast("int"))
    return numbered.join(F.broadcast(ranges), "bucket").drop("bucket")  # a row a class


def spread_by_duration(clips: DataFrame, buckets: DataFrame, count: int) -> DataFrame:
    """At most `count` clips (media_id, id, score, duration) of each medium: every bucket takes the best unused clip of its length, score order fills the rest."""
    # of a bucket at most as many as there are buckets can be chosen, of the rest at most `count`: the others can go before any list is built
    n = buckets.count() + count
    inside = F.col("duration").cast("double").between(F.col("lo"), F.col("hi")) | (F.col("hi") == F.lit(buckets.agg(F.max("hi")).first()[0])) & (F.col("duration") > F.col("hi"))
    first = Window.partitionBy("media_id", "bucket").orderBy(F.desc("score"), "id")
    of_bucket = clips.join(F.broadcast(buckets), inside).withColumn("r", F.row_number().over(first)).where(F.col("r") <= n)  # a row a bucket
    best = clips.withColumn("r", F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("score"), "id"))).where(F.col("r") <= n)
    clips = united(of_bucket.select("media_id", "id", "score", "duration"), best.select("media_id", "id", "score", "duration")).distinct()
    item = F.struct((-F.col("score")).alias("o"), "id", F.col("duration").cast("double").alias("d"))
    edges = buckets.agg(F.array_sort(F.collect_list(F.struct("bucket", "lo", "hi"))).alias("b"))
    lists = clips.groupBy("media_id").agg(F.array_sort(F.collect_list(item)).alias("items")).crossJoin(F.broadcast(edges))  # one row
    kind = "array<" + lists.schema["items"].dataType.elementType.simpleString() + ">"
    top = F.array_max(F.transform("b", lambda b: b["hi"]))

    def take(used, b):
        fits = lambda c: ~F.array_contains(used, c) & ((c["d"] >= b["lo"]) & (c["d"] <= b["hi"]) | (b["hi"] >= top) & (c["d"] > b["hi"]))
        return F.concat(used, F.slice(F.filter("items", fits), 1, 1))

    chosen = F.aggregate("b", F.array().cast(kind), take)
    filled = F.concat("chosen", F.filter("items", lambda c: ~F.array_contains(F.col("chosen"), c)))
    rows = lists.withColumn("chosen", chosen).withColumn("final", F.array_sort(F.slice(filled, 1, count)))
    return rows.select("media_id", F.posexplode("final").alias("pos", "x")).select("media_id", (F.col("pos") + 1).alias("rank"), "x.id")
