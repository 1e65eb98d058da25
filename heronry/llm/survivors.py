"""Best representative of each duplicate group (problem 1): iterative truth discovery.

Sources claim values for the fields of a record. A source's reliability and the support of each value are estimated in turn:
a value's support is the sum of its claims' weights times their sources' reliability, a source's reliability is the weighted
share of its claims that agree with the values of highest support. The rounds end when no reliability moves any more; if they
do not end, that is an error.

Recency: with ``older`` = 1/3 the newest claim of a field weighs 1 and all older claims together 1/3. Reliability lies between
0.5 and 0.99, so the newest known value has the highest support whatever its source (0.5 > 0.99 / 3); the reliabilities still
rank the sources and grade the support. With ``older`` = None every claim weighs 1 and the learned reliability decides.

p1_found wants the latest scan whatever its source, so there recency is a prior that no vote can turn; p1_survivors and
p1_trust take the plain vote: months of scans, the catalogue and the scans that named a best_path are sources, and a value of
trusted sources outvotes a newer one of a source that is often contradicted.

Defined cases: null values claim nothing; claims of equal time are ordered by their id; values of equal support go to the
newer claim; a repeated claim counts once more; no claims give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heronry.functions.hashes import parse_hash
from heronry.functions.paths import path_key
from heronry.functions.times import micros
from heronry.session import Scratch
from heronry.sources.tables import files_by_path, table

OLDER = 1 / 3
START, LOWEST, HIGHEST = 0.8, 0.5, 0.99


def discover(claims: DataFrame, older: float | None = OLDER, most_rounds: int = 60, tolerance: float = 0.002, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Claims (entity string, field, value string, source, at, claim_id) to (entity, field, value, support) and (source, trust).

    Claims are first summed by entity, field, value and source, so neither an entity nor a source with a third of all claims
    makes a long task. They are bucketed by entity once; each round then moves only one row per source and task."""
    spark = claims.sparkSession
    scratch = scratch or Scratch(spark, "truth")
    summed = (claims.where("entity IS NOT NULL AND field IS NOT NULL AND value IS NOT NULL")
              .groupBy("entity", "field", "value", F.coalesce("source", F.lit("")).alias("source"))
              .agg(F.count("*").alias("n"), F.max(F.struct("at", "claim_id")).alias("last")))
    slot = W.partitionBy("entity", "field")
    newest, rest = F.col("last") == F.max("last").over(slot), F.greatest(F.sum("n").over(slot) - 1, F.lit(1))
    weight = F.col("n").cast("double") if older is None else F.when(newest, 1 + older * (F.col("n") - 1) / rest).otherwise(older * F.col("n") / rest)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    votes = scratch.save_bucketed(summed.withColumn("w", weight).drop("n"), "votes", ["entity"], buckets)

    def settled(trust: DataFrame) -> DataFrame:
        per_value = (votes.join(trust, "source", "left").withColumn("s", F.col("w") * F.coalesce("trust", F.lit(START)))
                     .groupBy("entity", "field", "value").agg(F.sum("s").alias("support"), F.max("last").alias("last")))
        return per_value.groupBy("entity", "field").agg(F.max(F.struct("support", "last", "value")).alias("top"), F.sum("support").alias("all"))

    trust = spark.createDataFrame([], "source string, trust double")
    for r in range(most_rounds):
        truth = settled(trust)
        seen = votes.join(truth, ["entity", "field"]).groupBy("source").agg(
            F.sum("w").alias("w"), F.sum(F.when(F.col("value") == F.col("top.value"), F.col("w")).otherwise(0.0)).alias("agreed"))
        # two claims' worth of the starting value keeps rare sources from extremes
        now = F.least(F.lit(HIGHEST), F.greatest(F.lit(LOWEST), (F.col("agreed") + 2 * START) / (F.col("w") + 2)))
        if r >= 6:  # half steps, so that ties do not swing
            seen = seen.join(trust, "source", "left")
            now = (now + F.coalesce("trust", F.lit(START))) / 2
        after = scratch.save(seen.select("source", now.alias("trust")), "trust")
        moved = after.join(trust.withColumnRenamed("trust", "before"), "source", "left").agg(
            F.max(F.abs(F.col("trust") - F.coalesce("before", F.lit(START))))).first()[0]
        trust = after
        if not moved or moved < tolerance:
            break
    else:
        raise RuntimeError(f"reliabilities still move by {moved} after {most_rounds} rounds")
    values = settled(trust).select("entity", "field", F.col("top.value").alias("value"), (F.col("top.support") / F.col("all")).alias("support"))
    return values, trust


def _rank(**override: Column) -> Column:
    """Orders copies: highest resolution, largest size, earliest date, smallest id; unknown is last."""
    return F.struct("resolution", "size_bytes", (-micros(F.col("created_at"))).alias("age"), (-F.col("file_id")).alias("first"), *[v.alias(k) for k, v in override.items()])


def survivors(media_files: DataFrame, image_info: DataFrame, duplicate_groups: DataFrame, scratch: Scratch, older: float | None = OLDER, listed_best: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, trust). One record per duplicate_groups row that lists at least two different files with a media_files row:
    group_id, file_id and best_path of the best copy, and field by field its value or, where it has none, that of the
    next best copy that has one (resolution, size_bytes, created_at, hash), with the share of support for the resolution.

    With ``listed_best`` every row's best_path is a claim too, by its scan, on each file it lists: that it is the best, or
    that it is not; voted_id is the copy which the trusted scans support most (ties: the best copy), null if none claims."""
    files = files_by_path(media_files, "path", "size_bytes", "created_at")
    rows = duplicate_groups.where("group_id IS NOT NULL").select("group_id", "scan_id", F.col("created_at").alias("listed_at"), path_key("best_path").alias("bkey"), F.explode("paths").alias("p"))
    listed = rows.select("group_id", "scan_id", "listed_at", "bkey", path_key("p").alias("pkey")).distinct()
    member = scratch.save(listed.join(files, "pkey"), "members")
    wanted = scratch.save(member.select("pkey", "file_id", "size_bytes", "created_at").distinct(), "wanted")
    scans = image_info.select(path_key("path").alias("entity"), parse_hash(F.col("hash")).alias("h"), "resolution", "scanned_at", F.col("info_id").alias("claim_id"),
                              F.date_format("scanned_at", "'scans of' yyyy-MM").alias("source"))
    scans = scans.join(wanted.select(F.col("pkey").alias("entity")), "entity", "left_semi")
    claim = lambda df, field, value, at: df.select("entity", F.lit(field).alias("field"), value.cast("string").alias("value"), "source", F.col(at).alias("at"), "claim_id")
    catalogue = wanted.select(F.col("pkey").alias("entity"), F.lit("catalogue").alias("source"), "size_bytes", "created_at", F.col("file_id").alias("claim_id"))
    known = lambda c: F.when(F.col(c) > 0, F.col(c))
    claims = (claim(scans, "resolution", known("resolution"), "scanned_at")
              .unionByName(claim(scans, "hash", F.col("h"), "scanned_at"))
              .unionByName(claim(catalogue, "size_bytes", known("size_bytes"), "created_at"))
              .unionByName(claim(catalogue, "created_at", F.col("created_at"), "created_at")))
    if listed_best:
        named = member.where("bkey IS NOT NULL").select(F.col("pkey").alias("entity"), F.concat(F.lit("groups of "), F.coalesce("scan_id", F.lit("?"))).alias("source"),
                                                        (F.col("pkey") == F.col("bkey")).alias("is_best"), "listed_at", F.col("group_id").alias("claim_id"))
        claims = claims.unionByName(claim(named, "best", F.col("is_best"), "listed_at"))
    values, trust = discover(claims, older, scratch=scratch)
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    record = values.groupBy(F.col("entity").alias("pkey")).agg(
        pick("resolution", "value").cast("long").alias("resolution"), pick("resolution", "support").alias("support"), pick("hash", "value").cast("long").alias("h"),
        pick("size_bytes", "value").cast("long").alias("size_bytes"), pick("created_at", "value").cast(files.schema["created_at"].dataType).alias("created_at"),
        F.max(F.when(F.col("field") == "best", F.when(F.col("value") == "true", F.col("support")).otherwise(1 - F.col("support")))).alias("votes"))
    full = member.select("group_id", "pkey", "file_id", "path").join(record, "pkey", "left")
    # the best copy, and per field the best copy that knows it: partial maxima, no group is gathered
    best = F.max(_rank(path=F.col("path"), file_id=F.col("file_id"), support=F.col("support")))
    of = lambda c: F.max(F.when(F.col(c).isNotNull(), _rank(v=F.col(c))))["v"].alias(c)
    voted = F.max(F.when(F.col("votes").isNotNull(), F.struct("votes", _rank(v=F.col("file_id")).alias("r"))))["r"]["v"].alias("voted_id")
    records = (full.groupBy("group_id").agg(best.alias("best"), F.count("*").alias("copies"), *[of(c) for c in ("resolution", "size_bytes", "created_at", "h")], voted)
               .where("copies >= 2")
               .select("group_id", "best.file_id", F.col("best.path").alias("best_path"), "resolution", "size_bytes", "created_at", F.col("h").alias("hash"), "best.support", "copies", "voted_id"))
    return records, trust


def _run(spark, folder: str, **how) -> tuple[DataFrame, DataFrame]:
    return survivors(table(spark, folder, "media_files"), table(spark, folder, "image_info"), table(spark, folder, "duplicate_groups"), Scratch(spark, "p1"), **how)


def p1_found(spark, folder: str) -> DataFrame:
    """(group_id, file_id): the best copy of each group, from the surviving record by the newest known values."""
    return _run(spark, folder)[0].select("group_id", "file_id")


def p1_survivors(spark, folder: str) -> DataFrame:
    """The surviving record of each group by learned reliability, and the copy that trusted scans name as the best."""
    return _run(spark, folder, older=None, listed_best=True)[0]


def p1_trust(spark, folder: str) -> DataFrame:
    """(source, trust): what the vote learned about each source."""
    return _run(spark, folder, older=None, listed_best=True)[1].select("source", F.round("trust", 4).alias("trust"))
