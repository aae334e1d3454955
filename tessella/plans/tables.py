"""The operators over the generic tables: documents, events, orders and the rest.

Each query reads whole tables and goes through the operator that the rules use;
ORACLES has the SQL that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import annotate, policy, runs
from tessella.plans import rule_tables
from tessella.operators.groups import grouped, others, report_target

_WS = r"[ \t\n\r\f]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.lit("all").alias("group_id"), T.hash_text(T.collapse_spaces(F.col("text"), T.PLAIN_SPACE)).alias("hash"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("file"), F.lit(1).alias("line"), "doc_id", (F.col("doc_id") % 3 != 0).alias("reportable"))


def dup_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with the same content but for white space."""
    g = grouped(_doc_entries(spark, sf_dir), ["group_id", "hash"], collation=None, carry=["doc_id"])
    return g.select("hash", F.col("size").alias("n"), F.array_join(F.transform("entries", lambda e: e["doc_id"].cast("string")), ",").alias("doc_ids"))


def report_target_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host of each of those groups, where every third document may not host."""
    g = grouped(_doc_entries(spark, sf_dir), ["group_id", "hash"], collation=None, carry=["doc_id", "reportable"])
    g = g.withColumn("at", report_target(F.col("entries"), lambda e: e["reportable"])).where("at is not null")
    return g.select("hash", F.get("entries", F.col("at"))["doc_id"].alias("host"), others(F.col("entries"), F.col("at"), lambda e: e["file"]).alias("others"))


def first_reportable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each group that may host."""
    g = grouped(_doc_entries(spark, sf_dir), ["group_id", "hash"], collation=None, carry=["doc_id", "reportable"])
    g = g.withColumn("at", report_target(F.col("entries"), lambda e: e["reportable"], prefer_copy=False)).where("at is not null")
    return g.select("hash", F.get("entries", F.col("at"))["doc_id"].alias("host"))


def near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, 32 characters and more, that differ in case, digits or signs only."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    norm = F.regexp_replace(F.lower(F.btrim(F.regexp_replace("line", r"[^\p{L}0-9]+", " "))), "[0-9]+", "#")
    g = lines.withColumn("norm", norm).where(F.length("norm") >= 32).groupBy(T.hash_text(F.col("norm")).alias("line_hash"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("line").alias("n_texts"), F.min("doc_id").alias("first_doc")).where("n_texts > 1")


def near_dup_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that differ in numbers only."""
    g = table(spark, sf_dir, "pages").groupBy(F.regexp_replace("url", "[0-9]+", "N").alias("shape")).agg(F.count_distinct("url").alias("n_urls"), F.min("page_id").alias("first_page"))
    return g.where("n_urls > 1")


def normalized_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message text with literals and the words its role stands for made neutral, hashed."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.hash_text(T.normalize_body(F.col("text"), F.array(F.lit("de"), F.lit("the")))).alias("normalized_hash"), T.utf16_length(F.col("text")).alias("body_len"))


def name_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names used by several brands."""
    p = table(spark, sf_dir, "part").select(F.lit("all").alias("group_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"))
    return grouped(p, ["group_id", "name"], collation=None).where("n_files > 1").select("name", F.col("size").alias("n_parts"), F.col("n_files").alias("n_brands"))


def name_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every event type and of words with inner capitals in part types."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).union(table(spark, sf_dir, "part").select(F.replace("p_type", F.lit(" "), F.lit("_")).alias("name"))).distinct()
    return e.select("name", F.array_join(F.array_sort(T.name_segments(F.col("name"))), ",").alias("segments"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return d.where("trim(line) <> ''").select(F.lit("all").alias("group_id"), F.col("doc_id").alias("block_id"), F.col("pos"), T.hash_text(F.col("line")).alias("hash"), F.length("line").alias("norm_len"))


def maximal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal repeated runs of lines with all places of each."""
    found = runs.maximal_runs(_lines(spark, sf_dir))
    return found.select(F.col("length").cast("bigint").alias("length"), F.array_join(F.transform("participants", lambda p: F.concat(p["block"].cast("string"), F.lit(":"), p["pos"].cast("string"))), ",").alias("places"))


def repeated_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of over 20 characters in at least five sources, but for those under one language."""
    l = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", F.explode(F.split("text", "\n", -1)).alias("value")).where(F.length("value") > 20)
    g = l.groupBy("value").agg(F.count_distinct("source").alias("n_scopes"), F.count_distinct("lang").alias("n_keys"), F.min("doc_id").alias("first_doc"))
    return g.where("n_scopes >= 5 and n_keys <> 1").select(T.hash_text(F.col("value")).alias("value_hash"), "n_scopes", "n_keys", "first_doc")


def return_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of order priorities that at least three customers share."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("names")).where(F.size("names") >= 2)
    g = per.groupBy(F.array_join(F.array_sort("names"), "|").alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min("o_custkey").alias("first_customer"))
    return g.where("n >= 3")


def shape_hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of each event type's JSON keys, order playing no part, by the hash that the type rules group by."""
    from tessella.extract.facts import shape_hash

    e = table(spark, sf_dir, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("k")).distinct()
    members = F.collect_list(F.struct(F.col("k").alias("name"), F.lit(True).alias("optional"), F.lit(None).cast("string").alias("type_text"), F.lit(False).alias("method")))
    return e.groupBy("event_type").agg(members.alias("m")).select("event_type", shape_hash(F.col("m")).alias("shape"))


def constant_arg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of at least three lines with one line status, or one return flag."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_linestatus").alias("s"), F.min("l_linestatus").alias("status"), F.count_distinct("l_returnflag").alias("r"), F.min("l_returnflag").alias("flag"))
    g = g.where("n >= 3")
    return g.where("s = 1").select("l_orderkey", F.lit("l_linestatus").alias("param"), F.col("status").alias("value"), "n").union(g.where("r = 1").select("l_orderkey", F.lit("l_returnflag"), "flag", "n"))


def arg_never_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_discount").alias("most")).where("n >= 2 and most = 0").select("l_orderkey", "n")


def arg_always_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_tax").alias("least")).where("n >= 2 and least > 0").select("l_orderkey", "n")


def unused_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order: an anti join."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_name")


def dead_overload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities that a customer with orders never used, with the number of live ones."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()
    every = o.agg(F.collect_set("o_orderpriority").alias("all"))  # five priorities
    family = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.explode(F.lit(every.first()["all"])).alias("o_orderpriority"))
    matched = family.join(o.withColumn("hit", F.lit(1)), ["o_custkey", "o_orderpriority"], "left").withColumn("live", F.sum(F.coalesce("hit", F.lit(0))).over(Window.partitionBy("o_custkey")))
    return matched.where("hit is null and live > 0").select("o_custkey", "o_orderpriority", "live")


def explicit_null_arg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose property k is the empty value 0."""
    return table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k") == "0").select("event_id", "event_type")


def _pieces(df: DataFrame, mb: int = 4) -> int:
    """A number of partitions by the size of the files that df reads, at least the session's, so that a task's rows don't grow with them."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (mb << 20)))


def name_collision_unlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer, priority) groups of orders no two of which share a part."""
    lines = table(spark, sf_dir, "lineitem")
    n, group = _pieces(lines), ["o_custkey", "o_orderpriority"]
    o = table(spark, sf_dir, "orders").select("o_orderkey", *group)
    g = o.repartition(n, *group).groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    parts = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").repartition(n, "o_orderkey").join(o.repartition(n, "o_orderkey"), "o_orderkey")
    linked = parts.repartition(n, *group, "l_partkey").groupBy(*group, "l_partkey").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).where("lo < hi").select(*group)
    return g.join(linked, group, "left_anti")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets with the pages and links that point at them."""
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return p.groupBy("target").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("page_id").alias("n_pages"))


def overload_heritage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every earlier order on the chain of orders in which each one extends its customer's order before it, as a class its ancestors."""
    from tessella.operators.rules_node import heritage

    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return heritage(table(spark, sf_dir, "orders").where("o_custkey is not null").select(F.col("o_orderkey").alias("child"), before.alias("parent")), depth=None)


_POLICY = [(0, "*", "warning"), (1, "category:view", "off"), (2, "c*", "error"), (3, "purchase", "info"), (4, "tag:s", "error")]


def policy_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as rules under an ordered policy."""
    rules = table(spark, sf_dir, "events").select(F.col("event_type").alias("rule_id")).distinct().select("rule_id", F.lit("info").alias("severity"), F.col("rule_id").alias("category"), F.array(F.substring("rule_id", 1, 1)).alias("tags"), F.lit("proven").alias("confidence"))
    return policy.resolve_rules(rules, spark.createDataFrame(_POLICY, policy.POLICY)).select("rule_id", "severity")


def _event_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as diagnostics: users are files, event types rules, the value the severity."""
    severity = F.when(F.col("value") >= 90, "error").when(F.col("value") >= 40, "warning").otherwise("info")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("src/u"), F.col("user_id").cast("string")).alias("file"), F.col("event_type").alias("rule_id"), severity.alias("severity"), F.floor("value").cast("int").alias("line"), F.col("event_id").alias("seq"))


_OVERRIDES = [(0, "src/u1*", "click", "off"), (1, "src/u2*", "*", "info"), (2, "src/u22", "category:view", "error")]


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _event_diagnostics(spark, sf_dir)
    rules = d.select("rule_id").distinct().select("rule_id", F.col("rule_id").alias("category"), F.array().cast("array<string>").alias("tags"), F.lit("proven").alias("confidence"))
    out = policy.apply_overrides(d, _OVERRIDES, rules, F.col("file"))
    return out.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each (user, floor of value, type)."""
    return policy.dedupe(_event_diagnostics(spark, sf_dir)).select("file", "line", "rule_id", "severity", "seq")


def baseline_ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in (source, language) groups larger than their allowance."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("lang").alias("rule_id"), "doc_id")
    allowed = d.select("file", "rule_id").distinct().select("file", "rule_id", F.when(F.col("rule_id") == "en", 30).otherwise(9).alias("allowed"))
    return policy.apply_baseline(d, allowed).select("doc_id", F.col("file").alias("source"), F.col("rule_id").alias("lang"))


def make_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.make_baseline(_event_diagnostics(spark, sf_dir))


def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exit code of each event type's rows under every fail-on level."""
    top = _event_diagnostics(spark, sf_dir).groupBy("rule_id").agg(F.max(policy.severity_ord(F.col("severity"))).alias("top"))
    levels = F.explode(F.array(*[F.lit(x) for x in ("none", "error", "warning", "info")])).alias("fail_on")
    return top.select("rule_id", "top", levels).select("rule_id", "fail_on", policy.exit_code(F.col("top"), F.col("fail_on")).alias("exit_code"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.sources import sinks

    return sinks.summary(_event_diagnostics(spark, sf_dir))


def flat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the flat text form of the report."""
    from tessella.sources.sinks import flat_text

    d = _event_diagnostics(spark, sf_dir).withColumns({"col": F.lit(1), "message": F.lit("seen")})
    return d.select("seq", flat_text(F.col("file")).alias("value"))


def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without those that a toxic label suppresses."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.lit(1).alias("line"), F.lit("document").alias("rule_id"), F.lit("warning").alias("severity"))
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("file"), F.lit("Line").alias("kind"), F.when(F.col("toxic") == 1, F.lit("@allow document toxic")).otherwise("fine").alias("value"), F.lit(0).alias("start"), F.lit(9).alias("end"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    return annotate.suppress(d, l).select(F.col("file").cast("bigint").alias("doc_id"))


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn with the user turn right above it as its annotation."""
    c = table(spark, sf_dir, "conversations")
    d = c.where("role = 'assistant'").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").cast("int").alias("line"), F.lit(None).cast("string").alias("annotation"))
    said = c.where("role = 'user'").select(F.col("conv_id").cast("string").alias("file"), F.lit("Line").alias("kind"), T.hash_text(F.col("text")).alias("value"), F.col("turn").cast("int").alias("start"), F.col("turn").cast("int").alias("end"), F.col("turn").cast("int").alias("start_line"), F.col("turn").cast("int").alias("end_line"))
    return annotate.attach(d, said).select(F.col("file").cast("bigint").alias("conv_id"), F.col("line").alias("turn"), "annotation")


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents held against a snapshot in which those of one source are missing, German ones had another text and labelled toxic ones another group: what has to be read again."""
    from tessella.streaming.incremental import changed, fingerprints

    d = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("t_id")).distinct()
    now = d.join(toxic, F.col("doc_id") == F.col("t_id"), "left").select(F.lit("new").alias("group_id"), F.col("doc_id").cast("string").alias("file"), F.col("text").alias("source"), "lang", F.col("source").alias("origin"), F.col("t_id").isNotNull().alias("toxic"))
    then = now.where("origin <> 'src3'").select(F.when(F.col("toxic"), "old").otherwise("new").alias("group_id"), "file", F.when(F.col("lang") == "de", F.concat(F.lit("before "), "source")).otherwise(F.col("source")).alias("source"))
    return changed(now.select("group_id", "file", "source"), fingerprints(then)).select(F.col("file").cast("bigint").alias("doc_id"), T.hash_text(F.col("source")).alias("content_hash"))


def nearest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's nearest ancestor path among those that hold at least two pages."""
    from tessella.sources.files import nearest_ancestor

    p = table(spark, sf_dir, "pages").select(F.col("page_id"), F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "[?#].*$", "").alias("file"))
    folders = p.select(F.regexp_replace("file", "/[^/]*$", "").alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("folder")
    return nearest_ancestor(p, folders).select("page_id", "folder")


def path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host that ignore patterns leave."""
    p = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))
    left = p.where(~policy.ignored(F.col("path"), ["m.*/", "*.html", "!*5.html", "/blog.*/fr/**"]))
    return left.groupBy(F.regexp_extract("path", "^([^/]*)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "dup_file": dup_file, "report_target": report_target_query, "first_reportable": first_reportable, "near_dup": near_dup, "near_dup_url": near_dup_url, "normalized_body": normalized_body, "name_collision": name_collision, "name_segments": name_segments,
    "maximal_runs": maximal_runs, "repeated_literal": repeated_literal, "return_shape": return_shape, "shape_hash": shape_hash_query, "constant_arg": constant_arg, "arg_never_used": arg_never_used, "arg_always_used": arg_always_used,
    "unused_export": unused_export, "dead_overload": dead_overload, "explicit_null_arg": explicit_null_arg, "name_collision_unlinked": name_collision_unlinked, "edges": edges, "heritage": overload_heritage, "policy_resolve": policy_resolve, "overrides": overrides,
    "dedupe": dedupe, "baseline_ratchet": baseline_ratchet, "make_baseline": make_baseline, "exit_code": exit_code, "summary": summary, "flat_report": flat_report, "suppression": suppression, "annotation": annotation, "incremental": incremental,
    "nearest_group": nearest_group, "path_filters": path_filters, **rule_tables.QUERIES,
}
