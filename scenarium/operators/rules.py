"""Rules over sets of terms: every group of a rule must have a term (AND of ORs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenarium.dims import lookup
from scenarium.functions.text import detectable_term

#: Other spellings of a rule's terms.
TERM_ALIASES = {"cd": "compact disc", "forg": "frog"}
#: Terms of a prompt.
PROMPT_TERMS = 30


def parsed(evidence: Column) -> Column:
    """ARRAY<ARRAY<STRING>> of an evidence text: split by ``and``, then by ``or``; aliases added, each term once, no empty groups."""
    groups = F.split(detectable_term(evidence), "(?i)\\s+and\\s+")

    def terms(group: Column) -> Column:
        own = F.filter(F.transform(F.split(group, "(?i)\\s+or\\s+"), detectable_term), lambda t: t != "")
        more = F.transform(own, lambda t: F.array_compact(F.array(t, lookup(TERM_ALIASES, t))))
        return F.array_distinct(F.flatten(more))

    return F.filter(F.transform(groups, terms), lambda g: F.size(g) > 0)


def vocabulary(lines: DataFrame) -> DataFrame:
    """(line_no, name, evidence) of a vocabulary file's lines (line_no, line): ``name|evidence``.

    Lines between ``FROM HERE`` and ``TO HERE``, those markers, lines without ``|`` and those whose evidence is ``no`` are left out.
    The flag of the block is a running count over the file, which is as long as a vocabulary.
    """
    begin, end = F.upper("line").contains("FROM HERE"), F.upper("line").contains("TO HERE")
    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = F.sum(begin.cast("int") - end.cast("int")).over(w)
    rows = lines.withColumns({"inside": depth > 0, "mark": begin | end}).where("not inside and not mark and line like '%|%'")
    parts = F.split("line", "\\|", 2)
    rows = rows.select("line_no", F.trim(F.get(parts, F.lit(0))).alias("name"), F.trim(F.get(parts, F.lit(1))).alias("evidence"))
    return rows.where("name <> '' and evidence <> '' and lower(evidence) <> 'no'")


def build(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(rule_id, name, groups) of vocabulary rows, by name; names that resolve to no node, and second rules of a node, are left out.

    ``names``: (name, id), names in lower case.
    """
    found = rows.withColumn("key", F.lower("name")).join(names.select(F.col("name").alias("key"), "id"), "key").withColumn("groups", parsed(F.col("evidence"))).where("size(groups) > 0")
    w = Window.partitionBy("id").orderBy("line_no")
    return found.withColumn("i", F.row_number().over(w)).where("i = 1").select(F.col("id").alias("rule_id"), "name", "groups")


def terms_of(rules: DataFrame) -> DataFrame:
    """(rule_id, name, group_no, term, n_groups)."""
    g = rules.select("rule_id", "name", F.posexplode("groups").alias("group_no", "terms"), F.size("groups").alias("n_groups"))
    return g.select("rule_id", "name", "group_no", F.explode("terms").alias("term"), "n_groups")


def fired(evidence: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule_id): rules all of whose groups have a term in the key's evidence (key, term).

    Relational division: a join on terms, then a count of distinct groups; evidence is reduced to distinct terms first.
    """
    hits = evidence.select(key, "term").distinct().join(terms_of(rules), "term").select(key, "rule_id", "group_no", "n_groups").distinct()
    counted = hits.groupBy(key, "rule_id", "n_groups").agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n = n_groups").select(key, "rule_id")


def projected(detections: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, node_id, rule_id, name, confidence, terms, n_grounding, instance_count) of detections (key, term, confidence).

    confidence is the least of the groups' best ones; terms are the matched ones in order; n_grounding counts each firing
    detection per group; instance_count is known for rules of one group. Nodes are numbered by rule name.
    """
    hits = detections.where("term is not null").join(terms_of(rules), "term")
    group = hits.groupBy(key, "rule_id", "name", "n_groups", "group_no").agg(F.max("confidence").alias("best"), F.count(F.lit(1)).alias("n"), F.collect_set("term").alias("terms"))
    rule = group.groupBy(key, "rule_id", "name", "n_groups").agg(
        F.min("best").alias("confidence"), F.sum("n").alias("n_grounding"), F.count(F.lit(1)).alias("n_fired"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")
    )
    rule = rule.where("n_fired = n_groups")
    number = F.row_number().over(Window.partitionBy(key).orderBy("name", "rule_id"))
    return rule.select(key, F.concat(F.lit("n"), number.cast("string")).alias("node_id"), "rule_id", "name", "confidence", "terms", "n_grounding", F.when(F.col("n_groups") == 1, F.col("n_grounding")).alias("instance_count"))


def violations(nodes: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, violations): nodes (key, node_id, rule_id, terms) whose own terms don't satisfy their rule, or whose rule is unknown."""
    told = nodes.select(F.struct(key, "node_id").alias("__node"), "rule_id", F.explode_outer("terms").alias("term"))
    good = fired(told.select("__node", "term"), rules, "__node").withColumn("__ok", F.lit(1))
    judged = nodes.withColumn("__node", F.struct(key, "node_id")).join(good, ["__node", "rule_id"], "left")
    return judged.groupBy(key).agg(F.count_if(F.col("__ok").isNull()).alias("violations"))


def numbered(terms: DataFrame) -> DataFrame:
    """Distinct ``terms`` (term) with ``n``, their places in order from 0: counted per first two characters and added up over
    those, so that no window holds them all."""
    rows = terms.select("term").distinct().withColumn("__b", F.substring("term", 1, 2))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row per two characters
    starts = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("k")).select("__b", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("term"))
    return rows.withColumn("__i", inside).join(starts, "__b").select("term", (F.col("start") + F.col("__i") - 1).alias("n"))


def prompt_batches(terms: DataFrame, size: int = PROMPT_TERMS, prefix: str = "audioset_leaf_terms") -> DataFrame:
    """(batch, n_terms, prompt): distinct ``terms`` (term) in order, ``size`` to a prompt, numbered from 01."""
    rows = numbered(terms).withColumn("b", F.floor(F.col("n") / size) + 1)
    number = F.col("b").cast("string")
    name = F.concat(F.lit(prefix + ":"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))
    return rows.groupBy("b").agg(F.array_sort(F.collect_list("term")).alias("t")).select(name.alias("batch"), F.size("t").cast("bigint").alias("n_terms"), F.array_join("t", ", ").alias("prompt"))


def all_batches(leaf_terms: DataFrame, universal: list[str], scenes: dict[str, list[str]], box: float, text: float, size: int = PROMPT_TERMS) -> DataFrame:
    """(batch, n_terms, prompt, box_threshold, text_threshold): the leaf terms' batches, one of the ``universal`` terms, and one for each scene group
    (group -> terms), which are asked where an image's scene is of the group. Thresholds are the call's; see ``effective_thresholds``."""
    spark = leaf_terms.sparkSession
    fixed = [("universal", universal), *((f"scene:{group}", terms) for group, terms in scenes.items())]
    rows = spark.createDataFrame([(name, len(dict.fromkeys(t)), ", ".join(dict.fromkeys(t))) for name, t in fixed if t], "batch string, n_terms bigint, prompt string")
    return prompt_batches(leaf_terms, size).unionByName(rows).withColumns({"box_threshold": F.lit(box), "text_threshold": F.lit(text)})


def effective_thresholds(batches: DataFrame, box: float | None = None, text: float | None = None) -> DataFrame:
    """Batches with their thresholds, or those of the call where it gives some."""
    return batches.withColumns({"box_threshold": F.coalesce(F.lit(box).cast("double"), "box_threshold"), "text_threshold": F.coalesce(F.lit(text).cast("double"), "text_threshold")})


def scene_groups(scenes: DataFrame, exact: DataFrame, sets: DataFrame) -> DataFrame:
    """(scene, group, ord): a scene class's groups: the exhaustive map's, else those of every set that lists it.

    ``scenes``: (scene, normalised), ``exact``: (label, group), ``sets``: (group, label, ord).
    """
    one = scenes.join(exact.withColumnRenamed("label", "scene"), "scene").select("scene", "group", F.lit(0).alias("ord"))
    rest = scenes.join(exact.select(F.col("label").alias("scene")), "scene", "left_anti")
    return one.unionByName(rest.join(sets.withColumnRenamed("label", "scene"), "scene").select("scene", "group", "ord"))


def indoor_outdoor(label: Column, group: Column, indoor: list[str], outdoor: list[str]) -> Column:
    """What a scene label says itself, else what its group is."""
    return (
        F.when(label.contains("indoor"), "indoor").when(label.contains("outdoor"), "outdoor")
        .when(group.isin(indoor), "indoor").when(group.isin(outdoor), "outdoor").otherwise("unknown")
    )
