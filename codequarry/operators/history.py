"""Analyses, findings pages, reviews and retention as tables: append-only, the latest row wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import durable

PAGE, PAGE_MOST = 100, 500
#: States of reviews. Fixed values.
FINDING_STATES = ("open", "confirmed", "false_positive", "accepted", "fixed")
HOTSPOT_STATES = ("to_review", "acknowledged", "safe", "fixed")


def latest(analyses: DataFrame, *keys: str, epoch: str = "analyzed_epoch", tie: str = "id") -> DataFrame:
    """The last analysis of each project and branch; ids break ties. One aggregate, no sort of a whole branch."""
    rest = [c for c in analyses.columns if c not in keys]
    return analyses.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(epoch, tie)).alias("a")).select(*keys, "a.*")


def branch_summary(analyses: DataFrame, *keys: str, epoch: str = "analyzed_epoch", tie: str = "id") -> DataFrame:
    return analyses.groupBy(*keys).agg(F.count("*").alias("analyses"), F.max(epoch).alias("last_epoch"), F.max_by(tie, F.struct(epoch, tie)).alias("last_id"))


def page(findings: DataFrame, order: tuple[str, ...], after: tuple | None = None, size: int = PAGE) -> DataFrame:
    """One page in key order after a key, with one row more than asked for if there is a further page."""
    if not 1 <= size <= PAGE_MOST:
        raise ValueError(f"pages have 1 to {PAGE_MOST} rows")
    rows = findings
    if after is not None:
        # the first key's bound is implied; alone, it reaches the scan
        rows = rows.where(F.col(order[0]) >= F.lit(after[0])).where(F.struct(*order) > F.struct(*(F.lit(v).cast(findings.schema[c].dataType).alias(c) for c, v in zip(order, after))))
    return rows.orderBy(*order).limit(size + 1)


def ingested(known: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """The incoming analyses with outcome: stored, replayed (same content), or conflict (other content or deleted)."""
    old = known.select(*keys, F.col("content_hash").alias("__hash"), F.col("deleted_at").alias("__deleted"), F.lit(True).alias("__known"))
    out = incoming.join(old, list(keys), "left")
    outcome = F.when(F.col("__known").isNull(), "stored").when(F.col("__deleted").isNull() & (F.col("__hash") == F.col("content_hash")), "replayed").otherwise("conflict")
    return out.withColumn("outcome", outcome).drop("__hash", "__deleted", "__known")


def with_reviews(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings with the state of their review; ambiguous identities take none."""
    r = reviews.select("identity", "kind", "state", "version")
    clear = findings.where(~F.col("ambiguous")).join(r, ["identity", "kind"], "left")
    rest = findings.where("ambiguous").withColumns({"state": F.lit(None).cast("string"), "version": F.lit(None).cast("long")})
    return clear.unionByName(rest)


#: Seconds of a period by which long histories of one identity are split.
PERIOD = 30 * 86_400


def inherited_reviews(analyses: DataFrame, reviews: DataFrame, findings: DataFrame, period: int = PERIOD) -> DataFrame:
    """Reviews of earlier analyses of the same branch that carry over: equal context, unambiguous identity, latest first.

    An as-of join without pairs: findings and reviews stand in one row of events, and each finding takes the last review
    before it in its period, or else the last one of an earlier period that has any. Of one time's reviews the one of the
    largest analysis counts; what has no context or identity takes none.
    """
    at = analyses.select(F.col("id").alias("analysis_id"), "project", "branch", "analyzed_epoch", "context")
    key = ["project", "branch", "context", "identity", "kind"]
    old = reviews.select("analysis_id", "identity", "kind", "state").join(at, "analysis_id").groupBy(*key, "analyzed_epoch").agg(F.max_by(F.struct("state"), "analysis_id").alias("review"))
    new = findings.where(~F.col("ambiguous")).select("analysis_id", "identity", "kind").distinct().join(at, "analysis_id")
    events = new.withColumn("review", F.lit(None).cast("struct<state:string>")).unionByName(old.withColumn("analysis_id", F.lit(None).cast(at.schema["analysis_id"].dataType)))
    events = events.na.drop(subset=[*key, "analyzed_epoch"]).withColumn("period", F.floor(F.col("analyzed_epoch") / period))
    inside = Window.partitionBy(*key, "period").orderBy("analyzed_epoch").rangeBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("last", F.last("review", ignorenulls=True).over(inside))
    ends = events.groupBy(*key, "period").agg(F.max_by("review", F.when(F.col("review").isNotNull(), F.col("analyzed_epoch"))).alias("end"))
    earlier = Window.partitionBy(*key).orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("end", ignorenulls=True).over(earlier)).drop("end")
    on = [F.col(f"e.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*key, "period")]
    out = events.where("analysis_id is not null").alias("e").join(carried.alias("c"), on)
    taken = F.coalesce("e.last", "c.carried")
    return out.where(taken.isNotNull()).select("e.analysis_id", "e.identity", "e.kind", taken["state"].alias("state"))


def reviewed(reviews: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (identity, kind, expected_version, new_state) with outcome: accepted, stale version, or no such state for the kind."""
    r = requests.join(reviews.select("identity", "kind", "state", "version"), ["identity", "kind"], "left")
    allowed = F.when(F.col("kind") == "hotspot", F.col("new_state").isin(*HOTSPOT_STATES)).otherwise(F.col("new_state").isin(*FINDING_STATES))
    outcome = F.when(~allowed, "invalid").when(F.coalesce("version", F.lit(0)) != F.col("expected_version"), "stale").otherwise("accepted")
    return r.withColumn("outcome", outcome)


def broken_chains(history: DataFrame, *keys: str, order: str = "version", old: str = "previous_state", new: str = "new_state") -> DataFrame:
    """Rows of a review history that don't follow the one before: a gap in versions or another state."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, last = F.lag(new).over(w), F.lag(order).over(w)
    h = history.withColumns({"__before": before, "__last": last})
    bad = F.col("__last").isNotNull() & ((F.col(order) != F.col("__last") + 1) | ~F.col(old).eqNullSafe(F.col("__before")))
    return h.where(bad).drop("__before", "__last")


def retained(analyses: DataFrame, *keys: str, keep: int, epoch: str = "analyzed_epoch", tie: str = "id") -> DataFrame:
    """The analyses with ``expired``: whether ``keep`` later ones of the branch exist."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(epoch), F.desc(tie)))
    return analyses.withColumn("expired", rank > keep)


def deleted(analyses: DataFrame, where: Column, actor: str, reason: str, at: str) -> tuple[DataFrame, DataFrame]:
    """The analyses with soft deletions, and the audit rows of those newly deleted."""
    hit = where & F.col("deleted_at").isNull()
    audit = analyses.where(hit).select("project", F.lit("analysis").alias("resource_type"), F.col("id").alias("analysis_id"), F.lit("delete").alias("action"), F.lit(actor).alias("actor"), F.lit(reason).alias("reason"), F.lit(at).alias("created_at"))
    return analyses.withColumn("deleted_at", F.when(hit, F.lit(at)).otherwise(F.col("deleted_at"))), audit


def search_rules(catalog: DataFrame, word: str, *columns: str) -> DataFrame:
    """Catalog rows in which a column, or an element of an array column, holds the word in any case."""
    low, found = word.lower(), F.lit(False)
    kinds = dict(catalog.dtypes)
    for c in columns:
        found |= F.exists(c, lambda t: F.contains(F.lower(t), F.lit(low))) if kinds[c].startswith("array") else F.contains(F.lower(c), F.lit(low))
    return catalog.where(found)


def backup(projects: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows of each table (with project) that belong to the projects, and the projects themselves."""
    return {"projects": projects, **{name: d.join(projects.select("project"), "project", "left_semi") for name, d in tables.items()}}


def restore_problems(tables: dict[str, DataFrame], unique: dict[str, tuple[str, ...]]) -> DataFrame:
    """table, problem, n of a backup: rows of unknown projects, and repeated keys; no row means that it can be restored."""
    out = []
    known = tables["projects"].select("project")
    for name, d in tables.items():
        if name != "projects":
            out.append(d.join(known, "project", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit("unknown project").alias("problem"), "n"))
        if name in unique:
            again = d.groupBy(*unique[name]).agg(F.count("*").alias("c")).where("c > 1")
            out.append(again.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit("repeated key").alias("problem"), "n"))
    found = out[0]
    for d in out[1:]:
        found = found.unionByName(d)
    return found.where("n > 0")


def coverage_audit(catalog: DataFrame, implemented: DataFrame, tested: DataFrame) -> DataFrame:
    """language, keys, implemented, tested, missing, unknown (implemented but in no catalog) of rule keys (language, rule_key)."""
    c = catalog.select("language", "rule_key").distinct().withColumn("c", F.lit(True))
    i = implemented.select("language", "rule_key").distinct().withColumn("i", F.lit(True))
    t = tested.select("language", "rule_key").distinct().withColumn("t", F.lit(True))
    j = c.join(i, ["language", "rule_key"], "full").join(t, ["language", "rule_key"], "left")
    return j.groupBy("language").agg(F.count("c").alias("keys"), F.count_if(F.expr("c and i")).alias("implemented"), F.count_if(F.expr("c and i and t")).alias("tested"), F.count_if(F.expr("c and i is null")).alias("missing"), F.count_if(F.expr("c is null")).alias("unknown"))


def registered(findings: DataFrame, registry: DataFrame) -> DataFrame:
    """Findings of an isolated profile: those whose rule is in its own registry (rule_key)."""
    return findings.join(registry.select("rule_key").distinct(), "rule_key", "left_semi")


#: Rows of one key from which on they are dealt over so many salts.
HOT, SALTS = 50_000, 64


def _spread(paths: DataFrame, hot: int, salts: int) -> tuple[DataFrame, DataFrame]:
    """The paths by their ancestor and by their child (key, salt), so that no task gets all rows below a root."""
    often = F.broadcast(paths.groupBy(F.col("ancestor").alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key", F.lit(True).alias("hot")))
    below = paths.withColumn("key", F.col("ancestor")).join(often, "key", "left")
    below = below.select("key", F.when(F.col("hot"), F.pmod(F.xxhash64("child"), F.lit(salts))).otherwise(0).alias("salt"), "child", "depth")
    above = paths.withColumn("key", F.col("child")).join(often, "key", "left")
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return below, above.select("key", F.explode(every.cast("array<bigint>")).alias("salt"), F.col("ancestor").alias("up"), F.col("depth").alias("d"))


def ancestors(edges: DataFrame, child: str = "child", parent: str = "parent", rounds: int = 40, hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """child, ancestor, depth (the least) of a type hierarchy, cycles included; depth doubles with each round.

    A type that many have above them is met by salted rows: there are few such types, and each has few above itself.
    """
    out = edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).where("child is not null and ancestor is not null").distinct()
    n = -1
    for _ in range(rounds):
        out = durable(out)
        now = out.count()
        if now == n:
            return out
        n = now
        below, above = _spread(out, hot, salts)
        more = below.join(above, ["key", "salt"]).select("child", F.col("up").alias("ancestor"), (F.col("depth") + F.col("d")).alias("depth"))
        out = out.unionByName(more).groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))
    raise ValueError(f"hierarchy is deeper than {rounds} doublings")
