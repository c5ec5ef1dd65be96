"""Ontology nodes and links: scans, projections, first-link-wins parents, traversal, labels and construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotsman.functions.text import is_leaf, label_code, label_title, missing, strip
from lotsman.session import stash


def id_maps(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, code) and (code, id): of several nodes with a code the last one counts."""
    pairs = code_map(nodes.select("node_ord", "id", "code")).join(nodes.select("id", "node_ord"), "id")
    return code_map(nodes), pairs.groupBy("code").agg(F.max_by("id", "node_ord").alias("id"))


def with_descriptions(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """``nodes`` with the long descriptions that ``known`` (id, llm_description) has for them; others keep their own."""
    have = known.where(missing("llm_description").isNotNull()).groupBy("id").agg(F.min("llm_description").alias("_known"))
    return nodes.join(have, "id", "left").withColumn("llm_description", F.coalesce("_known", "llm_description")).drop("_known").select(*nodes.columns)


def code_map(nodes: DataFrame) -> DataFrame:
    """(id, code) of nodes that have both."""
    return nodes.where(nodes.id.isNotNull() & missing("code").isNotNull()).select("id", strip("code").alias("code"))


def texts(nodes: DataFrame) -> DataFrame:
    """(code, text): full label, else label, with the long description; the last node of a code wins."""
    label = F.coalesce(missing("full_label"), missing("label"))
    text = F.nullif(strip(F.concat_ws(". ", label, missing("llm_description")), r"\s."), F.lit(""))
    rows = nodes.where(missing("code").isNotNull()).select("node_ord", strip("code").alias("code"), F.coalesce(text, missing("full_label"), strip("code")).alias("text"))
    return rows.groupBy("code").agg(F.max_by("text", "node_ord").alias("text"))


def embedding_texts(nodes: DataFrame) -> DataFrame:
    """(id, text) without the fall-back to the label; nodes without text are left out."""
    return nodes.select("id", F.nullif(strip(F.concat_ws(". ", missing("full_label"), missing("llm_description")), r"\s."), F.lit("")).alias("text")).where("text is not null")


def competency_texts(comps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, text) of the competencies (id) whose node has a text to encode; the others are left out."""
    return comps.select("id").distinct().join(embedding_texts(nodes), "id")


def top_labels(nodes: DataFrame) -> DataFrame:
    """(code, top_code, top_label) of every code; the last node wins."""
    rows = nodes.where(missing("code").isNotNull()).select("node_ord", strip("code").alias("code"), F.coalesce(missing("full_label"), missing("label")).alias("top_label"))
    return rows.groupBy("code").agg(F.max_by("top_label", "node_ord").alias("top_label")).withColumn("top_code", F.substring_index("code", ".", 1))


def top_levels(nodes: DataFrame) -> DataFrame:
    """(code, label) of the two-digit codes; the first label wins."""
    rows = nodes.where(strip("code").rlike(r"^[0-9]{2}$")).select("node_ord", strip("code").alias("code"), "label")
    return rows.groupBy("code").agg(F.min_by("label", "node_ord").alias("label")).orderBy("code")


def display_map(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.coalesce(missing("full_label"), missing("label")).alias("label"))


def first_parents(links: DataFrame, skip: str | None = None) -> DataFrame:
    """(id, parent): of several links to a node the first one counts; links from ``skip`` do not."""
    rows = links.where(missing("source").isNotNull() & missing("target").isNotNull())
    rows = rows.where(F.col("target") != skip) if skip is not None else rows
    return rows.groupBy(F.col("target").alias("id")).agg(F.min_by("source", "link_ord").alias("parent"))


def children(links: DataFrame) -> DataFrame:
    """(id, children) in link order."""
    pairs = F.array_sort(F.collect_list(F.struct("link_ord", "target")))
    return links.groupBy(F.col("source").alias("id")).agg(F.transform(pairs, lambda x: x.target).alias("children"))


def leaves(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes without outgoing links."""
    return nodes.join(links.select(F.col("source").alias("id")).distinct(), "id", "left_anti")


def descendants(links: DataFrame, root: DataFrame) -> DataFrame:
    """(root, id): everything reached from each root, itself included; cycles end, as no node is visited twice.

    A breadth-first search to the last frontier, however deep.  Each frontier is written once to the shared folder and
    what was seen is the union of these tables, so nothing is written twice and plans stay short.
    """
    edges = links.select("source", "target").where("source is not null and target is not null").distinct()
    frontier = stash(root.select("root", F.col("root").alias("id")).distinct(), "frontier")
    seen = frontier
    while True:
        new = frontier.join(edges, F.col("id") == F.col("source")).select("root", F.col("target").alias("id")).distinct()
        frontier = stash(new.join(seen, ["root", "id"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def full_labels(nodes: DataFrame, parents: DataFrame, root: str | None = None) -> DataFrame:
    """(id, full_label): section of the grandparent, area of the parent, own label; root and blank labels are left out."""
    label = nodes.select(F.col("id").alias("lid"), label_title("label").alias("title"))
    not_root = lambda c: (F.col(c) != root) if root is not None else F.lit(True)
    p = parents.select("id", F.col("parent").alias("p"))
    g = parents.select(F.col("id").alias("p"), F.col("parent").alias("g"))
    joined = nodes.select("id", label_title("label").alias("own")).join(p, "id", "left").join(g, "p", "left")
    joined = joined.join(label.withColumnRenamed("lid", "p").withColumnRenamed("title", "pt"), "p", "left").join(label.withColumnRenamed("lid", "g").withColumnRenamed("title", "gt"), "g", "left")
    part = lambda word, c, k: F.when(missing(c).isNotNull() & not_root(k), F.concat(F.lit(word), missing(c)))
    return joined.select("id", F.concat_ws(". ", part("Раздел: ", "gt", "g"), part("Область: ", "pt", "p"), missing("own")).alias("full_label"))


def normalised(nodes: DataFrame, links: DataFrame, root: str | None = None) -> DataFrame:
    """Nodes with code, clean label and full label."""
    full = full_labels(nodes, first_parents(links, root), root)
    return nodes.drop("full_label", "code").withColumn("code", label_code("label")).withColumn("label", label_title("label")).join(full, "id", "left")


def competencies(nodes: DataFrame, links: DataFrame, prefix: str = "", leaves_only: bool = True) -> DataFrame:
    """(comp_ord, id, label, parent, description, full_label) of nodes with the prefix."""
    rows = nodes.where(F.col("id").startswith(prefix))
    rows = leaves(rows, links) if leaves_only else rows
    return rows.join(first_parents(links), "id", "left").select(F.col("node_ord").alias("comp_ord"), "id", "label", "parent", "description", "full_label")


def level_of(nodes: DataFrame) -> DataFrame:
    """(id, level): parts of the code, 0 without one."""
    return nodes.select("id", F.when(missing("code").isNull(), 0).otherwise(F.size(F.split(strip("code"), r"\."))).alias("level"))


def parse_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, p1, p2, p3, text) of anchors with query parameters p1, p2, p3 in an ``html`` column."""
    anchors = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"), 1)).alias("pos", "a"))
    href = F.regexp_extract("a", r"(?i)href\s*=\s*[\"']([^\"']*)", 1)
    par = lambda p: F.nullif(F.regexp_extract(href, rf"[?&](?:amp;)?{p}=([^&\"']*)", 1), F.lit(""))
    return anchors.select("page_id", "pos", par("p1").alias("p1"), par("p2").alias("p2"), par("p3").alias("p3"), strip(F.regexp_replace("a", r"(?s)<[^>]*>", "")).alias("text"))


def levels_from_links(links: DataFrame) -> DataFrame:
    """(code, title, level, parent): one row a code of parsed links, the last one wins; a third level must extend its second."""
    code = F.coalesce("p3", "p2", "p1")
    level = F.when(F.col("p3").isNotNull(), 3).when(F.col("p2").isNotNull(), 2).otherwise(1)
    rows = links.where("p1 is not null").select(F.struct("page_id", "pos").alias("o"), code.alias("code"), label_title("text").alias("title"), level.alias("level"), "p1", "p2", "p3")
    rows = rows.where((F.col("level") < 3) | F.col("p3").startswith(F.concat("p1", F.lit("."), F.substring_index("p2", ".", -1), F.lit("."))))
    return rows.groupBy("code").agg(F.max_by("title", "o").alias("title"), F.max_by("level", "o").alias("level")).withColumn("parent", F.when(F.col("level") > 1, F.regexp_replace("code", r"\.[^.]*$", ""))).orderBy("code")


def build(levels: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, links) from ``levels_from_links``: a node a code, a link from its parent."""
    from lotsman.functions.text import node_id

    nodes = levels.select(node_id(prefix, "code").alias("id"), F.concat_ws(" ", "code", "title").alias("label"), "code", "level")
    links = levels.where("parent is not null").select(node_id(prefix, "parent").alias("source"), node_id(prefix, "code").alias("target"), F.lit("has_child").alias("predicate"))
    return nodes, links


def leaf_codes(nodes: DataFrame) -> DataFrame:
    return code_map(nodes).where(is_leaf("code"))


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of an ontology file, with their ordinals."""
    node = "id string,label string,type string,children array<string>,version int,author string,description string,code string,full_label string,llm_description string"
    doc = spark.read.schema(f"nodes array<struct<{node}>>, links array<struct<source string,target string,predicate string>>").json(path, multiLine=True)
    nodes = doc.select(F.posexplode("nodes").alias("node_ord", "n")).select(F.col("node_ord").cast("bigint"), "n.*")
    return nodes, doc.select(F.posexplode("links").alias("link_ord", "l")).select(F.col("link_ord").cast("bigint"), "l.*")
