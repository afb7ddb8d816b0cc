"""Voting (inventory 2.10 and the window functions behind it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonagrid.operators import voting
from sonagrid.plans.registry import query
from sonagrid.sources import fixtures as fx

_W = ("windows",)


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of two to eight windows: the turns of conversations."""
    c = fx.table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("chunk_id"), F.col("turn").cast("int").alias("idx"), (F.col("turn") * 2.5).cast("double").alias("start_sec"), (F.col("turn") * 2.5 + 5).cast("double").alias("end_sec"), F.col("role").alias("species"), (F.length("text") % 100 / 100.0).alias("prob"))


#: Winners by SQL: each window against the species of its last three windows.
def _winners(source: str, tie: str) -> str:
    return f"""(SELECT * FROM (SELECT a.chunk_id, a.idx, b.species, count(*) AS n, min(b.start_sec) AS s, max(b.end_sec) AS e, max(b.prob) AS top, avg(b.prob) AS mean, min(b.idx) AS first_idx,
      row_number() OVER (PARTITION BY a.chunk_id, a.idx ORDER BY count(*) DESC, {tie}) AS r
      FROM {source} a JOIN {source} b ON a.chunk_id = b.chunk_id AND b.idx BETWEEN a.idx - 2 AND a.idx AND b.species IS NOT NULL GROUP BY 1, 2, 3) WHERE r = 1 AND n >= 2)"""


_SPANS = """WITH h AS (SELECT *, max(e) OVER (PARTITION BY chunk_id, species ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {w}),
  i AS (SELECT *, sum(CASE WHEN s <= reach + 1e-6 THEN 0 ELSE 1 END) OVER (PARTITION BY chunk_id, species ORDER BY idx) AS island FROM h)
  SELECT chunk_id, species, min(s)::DOUBLE AS start_sec, max(e)::DOUBLE AS end_sec, max(top)::DOUBLE AS confidence, max(n)::INT AS votes, count(*) AS hits FROM i GROUP BY chunk_id, species, island"""


def _spans(windows: DataFrame) -> DataFrame:
    return voting.vote_spans(windows).select("chunk_id", "species", "start_sec", "end_sec", "confidence", "votes")


@query("SELECT chunk_id, species, start_sec, end_sec, confidence, votes FROM (" + _SPANS.format(w=_winners("windows", "b.species DESC")) + ")", _W)
def vote_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(fx.windows(spark, sf_dir))


_SHORT = "(SELECT conv_id AS chunk_id, turn::INT AS idx, (turn * 2.5)::DOUBLE AS start_sec, (turn * 2.5 + 5)::DOUBLE AS end_sec, role AS species, (length(text) % 100 / 100.0)::DOUBLE AS prob FROM conversations)"


@query("WITH short AS " + _SHORT + " SELECT chunk_id, species, start_sec, end_sec, confidence, votes FROM (" + _SPANS.format(w=_winners("short", "b.species DESC")) + ")")
def vote_server_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_short(spark, sf_dir))


@query(
    "WITH RECURSIVE short AS " + _SHORT + ", h AS (SELECT *, max(e) OVER (PARTITION BY chunk_id, species ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM " + _winners("short", "b.species DESC") + """),
  i AS (SELECT *, sum(CASE WHEN s <= reach + 1e-6 THEN 0 ELSE 1 END) OVER (PARTITION BY chunk_id, species ORDER BY idx) AS island FROM h), o AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, species, island ORDER BY idx) AS k FROM i),
  f AS (SELECT chunk_id, species, island, k, mean::DOUBLE AS z FROM o WHERE k = 1 UNION ALL SELECT f.chunk_id, f.species, f.island, o.k, (f.z + o.mean) / 2 FROM f JOIN o ON o.chunk_id = f.chunk_id AND o.species = f.species AND o.island = f.island AND o.k = f.k + 1)
  SELECT chunk_id, species, count(*)::INT AS hits, round(arg_max(z, k), 6) AS mean_confidence FROM f GROUP BY chunk_id, species, island"""
)
def vote_mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = voting.vote_spans(_short(spark, sf_dir))
    winners = voting._winner(_short(spark, sf_dir), voting.M, voting.K, "greatest").select("chunk_id", "start_sec", F.col("vote.species").alias("species"))
    counts = spans.alias("s").join(winners.alias("w"), F.expr("s.chunk_id = w.chunk_id and s.species = w.species and w.start_sec + 5 > s.start_sec and w.start_sec <= s.end_sec + 2.5")).groupBy("s.chunk_id", "s.species", "s.start_sec").agg(F.count("*").cast("int").alias("hits"))
    return spans.join(counts, ["chunk_id", "species", "start_sec"]).select("chunk_id", "species", "hits", F.round("mean_confidence", 6).alias("mean_confidence"))


_FIRST = _winners("windows", "min(b.idx)")


@query(f"SELECT chunk_id, idx, species, n::INT AS votes, round(idx * 2.5, 2)::DOUBLE AS time_sec FROM (SELECT *, lag(species) OVER (PARTITION BY chunk_id ORDER BY idx) AS before FROM {_FIRST}) WHERE before IS NULL OR before <> species", _W)
def vote_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.vote_changes(fx.windows(spark, sf_dir)).select("chunk_id", "idx", "species", "votes", "time_sec")


@query(f"SELECT c.chunk_id, c.idx, c.species, start_sec, end_sec, confidence FROM (SELECT * FROM (SELECT *, lag(species) OVER (PARTITION BY chunk_id ORDER BY idx) AS before FROM {_FIRST}) WHERE before IS NULL OR before <> species) c JOIN (SELECT chunk_id, species, min(start_sec) AS start_sec, max(end_sec) AS end_sec, max(prob) AS confidence FROM windows WHERE species IS NOT NULL GROUP BY 1, 2) w ON w.chunk_id = c.chunk_id AND w.species = c.species", _W)
def vote_model_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.vote_change_spans(fx.windows(spark, sf_dir)).select("chunk_id", "idx", "species", "start_sec", "end_sec", "confidence")


@query(
    f"""SELECT chunk_id, species, idx, n::INT AS votes, round(mean, 6) AS avg_confidence FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, run, idx - k ORDER BY idx) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY chunk_id, run ORDER BY idx) AS k FROM (SELECT *, sum(CASE WHEN before = species THEN 0 ELSE 1 END) OVER (PARTITION BY chunk_id ORDER BY idx) AS run
      FROM (SELECT *, lag(species) OVER (PARTITION BY chunk_id ORDER BY idx) AS before FROM {_FIRST})))) WHERE place % 2 = 1""",
    _W,
)
def vote_mobile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.vote_mobile(fx.windows(spark, sf_dir)).select("chunk_id", "species", "idx", "votes", F.round("avg_confidence", 6).alias("avg_confidence"))


@query("SELECT chunk_id, count(*) AS n, CAST(sum(CASE WHEN species IS NULL OR prob < 0.6 THEN 0 ELSE 1 END) AS BIGINT) AS detected FROM windows GROUP BY 1", _W)
def fn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fx.windows(spark, sf_dir)
    return w.groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_if(voting.classify(F.col("species"), F.col("prob")) == "detected").alias("detected"))


@query("SELECT chunk_id, idx, start_sec, end_sec FROM windows", _W)
def vote_make_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = fx.windows(spark, sf_dir).groupBy("chunk_id").agg(F.count("*").alias("n"))
    rows = sizes.select("chunk_id", F.posexplode(voting.window_starts((F.col("n") - 1) * 2.5 + 5.0)).alias("idx", "start_sec"))
    return rows.select("chunk_id", "idx", F.col("start_sec").cast("double").alias("start_sec"), (F.col("start_sec") + 5.0).cast("double").alias("end_sec"))


@query("SELECT a.chunk_id, a.idx, string_agg(coalesce(b.species, '-'), ',' ORDER BY b.idx) AS buffer FROM windows a JOIN windows b ON a.chunk_id = b.chunk_id AND b.idx BETWEEN a.idx - 2 AND a.idx GROUP BY 1, 2", _W)
def win_vote_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = voting._buffered(fx.windows(spark, sf_dir), 3)
    return rows.select("chunk_id", "idx", F.array_join(F.transform(F.sort_array("buf"), lambda b: F.coalesce(b["species"], F.lit("-"))), ",").alias("buffer"))


@query("SELECT user_id AS chunk_id, min(ts) + INTERVAL 5 SECONDS AS window_end_ts FROM events GROUP BY 1")
def vote_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = fx.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("chunk_id")).agg(F.min("ts").alias("started_at"))
    spans = fx.windows(spark, sf_dir).filter("idx = 0").select("chunk_id", "start_sec", "end_sec")
    return voting.to_absolute(spans, chunks).select("chunk_id", "window_end_ts")


@query("SELECT chunk_id, idx, round(n / least(idx + 1, 3), 6)::DOUBLE AS ratio FROM " + _winners("windows", "b.species DESC"), _W)
def vote_support_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = voting._winner(fx.windows(spark, sf_dir), 3, 2, "greatest")
    return rows.select("chunk_id", "idx", F.round(voting.support_ratio(F.col("vote.n"), F.size("buf")), 6).alias("ratio"))
