"""Tree operators: wiring, flags that propagate, patterns lifted to containers, ancestors and lookups.

Nodes are one wide table; `ord` stands for insertion order, so ties break the same way on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import text, vectors
from canopy.plans.settle import settled

LEAVES = ("function", "type")
HELPER_CALLERS = 2
MIN_PATTERN = 2


def is_leaf(kind: Column) -> Column:
    return kind.isin(*LEAVES)


def wire_parents(nodes: DataFrame, directories: DataFrame) -> DataFrame:
    """Set parent_key from the directories' children lists; a child that no list names keeps what it had."""
    child = F.explode("children")
    edges = directories.select(F.concat(F.lit("dir:"), F.col("path")).alias("_parent"), child.alias("_child"))
    keys = edges.select("_parent", F.explode(F.array(F.concat(F.lit("file:"), F.col("_child")), F.concat(F.lit("dir:"), F.col("_child")))).alias("key"))
    keys = keys.groupBy("key").agg(F.max("_parent").alias("_parent"))
    return nodes.join(keys, "key", "left").withColumn("parent_key", F.coalesce("_parent", "parent_key")).drop("_parent")


def detect_helpers(nodes: DataFrame) -> DataFrame:
    """An unexported function that two or more functions of its file call is a helper."""
    functions = nodes.where("kind = 'function'")
    called = functions.select("path", F.explode(F.array_distinct("calls")).alias("name")).groupBy("path", "name").agg(F.count("*").alias("_callers"))
    found = functions.join(called, ["path", "name"]).where(~F.col("exported") & (F.col("_callers") >= HELPER_CALLERS)).select("key", F.lit(True).alias("_helper"))
    return nodes.join(found, "key", "left").withColumn("helper", F.coalesce("_helper", "helper")).drop("_helper")


def propagate_util(nodes: DataFrame) -> DataFrame:
    """A container whose children all are util becomes util, in one pass: files first, then directories as they were met.

    Directories are met parents first, so a directory sees its sub-directories as they were before the pass.
    """

    def one_pass(rows: DataFrame, kind: str) -> DataFrame:
        below = rows.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.bool_and("util").alias("_all"))
        found = rows.join(below, "key", "left")
        return found.withColumn("util", F.col("util") | ((F.col("kind") == kind) & F.coalesce("_all", F.lit(False)))).drop("_all")

    return one_pass(one_pass(nodes, "file"), "directory")


def eligible_children(nodes: DataFrame) -> DataFrame:
    """Children with their parent's key and util flag: all of a util parent, else those neither util nor inward."""
    parents = nodes.select(F.col("key").alias("_pk"), F.col("util").alias("parent_util"))
    joined = nodes.join(parents, F.col("parent_key") == F.col("_pk")).drop("_pk")
    return joined.where(F.col("parent_util") | (~F.col("util") & ~F.col("bound").eqNullSafe(F.lit("inward"))))


def root_key(nodes: DataFrame) -> DataFrame:
    """One row: the first directory without a parent."""
    return nodes.where("kind = 'directory' and parent_key is null").orderBy("ord").limit(1).select("key")


def ancestors(nodes: DataFrame, most: int = 64) -> DataFrame:
    """Rows (key, ancestor, distance): nearest first from 1, without the root; one join for each level there is."""
    edges = nodes.where("parent_key is not null").select("key", "parent_key")
    up = edges.select(F.col("key").alias("_k"), F.col("parent_key").alias("_p"))
    front = edges.select("key", F.col("parent_key").alias("ancestor"), F.lit(1).alias("distance"))
    inner = up.select(F.col("_k").alias("ancestor"))
    found = None
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for _ in range(min(most, deepest)):
        kept = front.join(inner, "ancestor", "left_semi").select("key", "ancestor", "distance")
        found = kept if found is None else found.unionByName(kept)
        front = front.join(up, F.col("ancestor") == F.col("_k")).select("key", F.col("_p").alias("ancestor"), (F.col("distance") + 1).alias("distance"))
    return found if found is not None else front


def nearest_common_directory(paths: Column) -> Column:
    """The longest common directory of an array of file paths."""
    folders = F.transform(paths, lambda p: F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1))
    return F.array_join(
        F.aggregate(
            F.slice(folders, 2, F.greatest(F.size(folders), F.lit(0))),
            F.get(folders, 0),
            lambda a, b: F.filter(F.transform(a, lambda x, i: F.when(F.slice(a, 1, i + 1) == F.slice(b, 1, i + 1), x)), lambda x: x.isNotNull()),
        ),
        "/",
    )


def in_file_patterns(nodes: DataFrame, depth: int = 0) -> DataFrame:
    """Rows (parent_key, tag, members, pattern_key) of the groups that two or more leaves of one parent make at a tag depth."""
    tagged = nodes.where(is_leaf(F.col("kind")) & (F.size("patterns") > depth)).withColumn("tag", F.get("patterns", depth))
    groups = tagged.groupBy("parent_key", "tag").agg(F.count("*").alias("members"), F.min("ord").alias("first_ord")).where(F.col("members") >= MIN_PATTERN)
    return groups.withColumn("pattern_key", F.concat_ws(":", F.lit("pattern"), "parent_key", "tag"))


def _pattern_rows(members: DataFrame, columns: list[str]) -> DataFrame:
    """One container for each pattern_key of members (with tag and holder): its vectors are the members' centroids."""
    facts = members.groupBy("pattern_key").agg(F.max("tag").alias("name"), F.max("holder").alias("parent_key"), F.min("ord").alias("ord"), F.max("path").alias("path"), F.min("depth").alias("depth"))
    for c in ("identity", "leaf"):
        means = members.where(~vectors.is_empty(F.col(c))).groupBy("pattern_key").agg(vectors.centroid(F.col(c)).alias(c))
        facts = facts.join(means, "pattern_key", "left").withColumn(c, F.coalesce(c, vectors.empty()))
    fixed = {"key": F.col("pattern_key"), "kind": F.lit("pattern"), "patterns": F.array(), "residuals": F.array(), "util": F.lit(False), "helper": F.lit(False), "exported": F.lit(False), "pure": F.lit(False)}
    kinds = {f.name: f.dataType for f in members.schema.fields}
    return facts.select(*[(fixed.get(c) if c in fixed else F.col(c) if c in facts.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns])


def group_patterns(nodes: DataFrame, levels: int | None = None) -> DataFrame:
    """nodes with a container for each in-file pattern group, level by level down the tags."""
    if levels is None:
        levels = nodes.agg(F.max(F.size("patterns"))).first()[0] or 0
    current, columns = nodes, nodes.columns
    for depth in range(levels):
        groups = in_file_patterns(current, depth).select(F.col("parent_key").alias("_gp"), F.col("tag").alias("_gt"), "pattern_key")
        if depth:  # only the members of a group go on to its next tag
            groups = groups.where(F.col("_gp").startswith("pattern:"))
        tag = F.when(is_leaf(F.col("kind")) & (F.size("patterns") > depth), F.get("patterns", depth))
        moved = current.withColumn("_tag", tag).join(groups, (F.col("parent_key") == F.col("_gp")) & (F.col("_tag") == F.col("_gt")), "left")
        members = moved.where("pattern_key is not null").withColumns({"tag": F.col("_tag"), "holder": F.col("parent_key")})
        moved = moved.withColumn("parent_key", F.coalesce("pattern_key", "parent_key")).select(*columns)
        current = settled(moved.unionByName(_pattern_rows(members, columns)))
    return current


def lift_patterns(nodes: DataFrame) -> DataFrame:
    """nodes (grouped already) with a container, at the nearest common directory, for each tag of two files or more.

    A file's part in it is its own pattern container, or its one unit of that tag.
    """
    files = nodes.where("kind = 'file'").select(F.col("key").alias("_file"), F.col("path").alias("_path"))
    tag = F.when(F.col("kind") == "pattern", F.col("name")).when(is_leaf(F.col("kind")), F.get("patterns", 0))
    parts = nodes.withColumn("tag", tag).where("tag is not null").join(files, F.col("parent_key") == F.col("_file"))
    placed = cross_file_patterns(parts.select("tag", F.col("_path").alias("path")), nodes)
    members = parts.join(placed.select("tag", F.col("directory_key").alias("holder")), "tag")
    members = members.withColumn("pattern_key", F.concat_ws(":", F.lit("pattern"), "holder", "tag"))
    above = members.select("key", F.col("pattern_key").alias("_above"))
    moved = nodes.join(above, "key", "left").withColumn("parent_key", F.coalesce("_above", "parent_key")).select(*nodes.columns)
    return moved.unionByName(_pattern_rows(members, nodes.columns))


def cross_file_patterns(tagged: DataFrame, nodes: DataFrame) -> DataFrame:
    """tagged (tag, path) -> (tag, files, directory_key): tags of two files or more, at the nearest directory common to them."""
    # One path a folder is enough for the common directory, so the array is bounded by folders, not by units.
    folders = tagged.groupBy("tag", text.parent_path(F.col("path")).alias("folder")).agg(F.min("path").alias("path"), F.count_distinct("path").alias("files"))
    groups = folders.groupBy("tag").agg(F.sum("files").alias("files"), F.sort_array(F.collect_list("path")).alias("paths")).where("files >= 2")
    placed = groups.select("tag", "files", F.concat(F.lit("dir:"), nearest_common_directory(F.col("paths"))).alias("directory_key"))
    known = nodes.where("kind = 'directory'").select(F.col("key").alias("directory_key"))
    return placed.join(known, "directory_key", "left_semi")


def count_children(cards: DataFrame) -> DataFrame:
    """cards (key, kind) -> (key, children): direct children by the paths in the keys."""
    rows = cards.withColumn("_p", text.key_path(F.col("key")))
    units = rows.where(is_leaf(F.col("kind"))).groupBy(F.concat(F.lit("file:"), F.col("_p")).alias("key")).agg(F.count("*").alias("n"))
    inner = rows.where(F.col("kind").isin("file", "directory")).groupBy(F.concat(F.lit("dir:"), text.parent_path(F.col("_p"))).alias("key")).agg(F.count("*").alias("n"))
    return cards.select("key").join(units.unionByName(inner), "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("children"))


def capability_root(nodes: DataFrame) -> DataFrame:
    """One row: the first util directory right under the root."""
    top = nodes.where("kind = 'directory' and util").join(root_key(nodes).select(F.col("key").alias("_r")), F.col("parent_key") == F.col("_r"))
    return top.orderBy("ord").limit(1).select("key")


def first_of_group(nodes: DataFrame, group: Column) -> DataFrame:
    """One node a group (pattern tag or companion), with the group's size; nodes without a group stay."""
    held = nodes.withColumn("_g", F.coalesce(group, F.col("key")))
    w = Window.partitionBy("_g")
    ranked = held.withColumn("group_size", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy("ord")))
    return ranked.where("_n = 1").drop("_n", "_g")
