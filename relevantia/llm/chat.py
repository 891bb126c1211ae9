"""Chat formatting of reply trees (native plan).

Messages form trees: each has a node, a parent and a score. Iterative self-joins
enumerate the root-to-leaf paths: a table of jumps holds for every node its ancestor
2**k steps up, with the sum of scores and the number of nodes on the way; joining it with
itself doubles k. So the rounds are the logarithm of the deepest tree, and only ids move.
When all jumps have left their roots, every leaf has the score of its path: leaves are
ranked within their tree by mean score, then length, then leaf. Only the chosen paths are
enumerated, each round doubling their length by the jumps kept; texts join once, at the
end, and each chosen path is formatted as one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and texts
``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|`` (in roles a line feed ``&#10;``
too), so that no text can forge a mark and each can be read back. The loss mask is a
list of spans of the formatted text, in code points: the text of each assistant turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, staged, table

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&#10;"))


def _role_back(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def chains(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Linear conversations as trees: ``tree, node, parent, role, text, score``; a null turn comes first, turns that tie go by role, then text, nulls first.

    Rows without a conversation are one conversation, whose tree is null.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = rows.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _key(tree: Column) -> Column:
    return F.coalesce(F.concat(F.lit("t"), tree.cast("string")), F.lit("n"))


def node_ids(nodes: DataFrame) -> DataFrame:
    """(t, tree, node, parent, score) of each node once; a parent that does not exist becomes null, a null score 0."""
    ids = nodes.where("node IS NOT NULL").select(_key(F.col("tree")).alias("t"), "tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")).dropDuplicates(["t", "node"])
    ids = staged(ids, "chat-ids")
    real = ids.select("t", F.col("node").alias("parent"), F.lit(True).alias("real"))
    return staged(ids.join(real, ["t", "parent"], "left").select("t", "tree", "node", F.when(F.col("real"), F.col("parent")).alias("parent"), "score"), "chat-nodes")


def leaf_scores(ids: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """From node_ids() the leaves (t, tree, leaf, score, length) with their path's sum, and the jumps (t, node, to) by powers of two, an empty one last.

    A cycle has no leaf below it or its path never ends: it is not among the leaves.
    """
    now = ids.select("t", "node", F.col("parent").alias("to"), "score", F.lit(1).cast("long").alias("length"))
    jumps, most, step = [], ids.count(), 1
    while True:
        open_ = now.where("to IS NOT NULL")
        jumps.append(open_.select("t", "node", "to"))
        if step > most or open_.isEmpty():
            break
        far = now.select("t", F.col("node").alias("to"), F.col("to").alias("next"), F.col("score").alias("more"), F.col("length").alias("longer"))
        doubled = open_.join(far, ["t", "to"]).select("t", "node", F.col("next").alias("to"), (F.col("score") + F.col("more")).alias("score"), (F.col("length") + F.col("longer")).alias("length"))
        now, step = staged(now.where("to IS NULL").unionByName(doubled), "chat-jumps"), step * 2
    parents = ids.where("parent IS NOT NULL").select("t", F.col("parent").alias("node")).distinct()
    leaves = now.where("to IS NULL").join(parents, ["t", "node"], "left_anti").join(ids.select("t", "node", "tree"), ["t", "node"])
    return leaves.select("t", "tree", F.col("node").alias("leaf"), "score", "length"), jumps


def best_leaves(leaves: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """leaves with ``path_rank``, the per_tree best of each tree (None: all): by mean score, then length, then leaf."""
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("mean"), F.desc("length"), "leaf"))
    # Rounded, so that the order of additions decides no tie.
    ranked = leaves.withColumn("mean", F.round(F.col("score") / F.col("length"), 9)).withColumn("path_rank", rank)
    return (ranked if per_tree is None else ranked.where(F.col("path_rank") <= per_tree)).drop("mean")


def paths_of(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """chosen (t, leaf, ...) with each path's nodes (``node``), ``up`` steps above its leaf."""
    paths = staged(chosen.withColumn("node", F.col("leaf")).withColumn("up", F.lit(0).cast("long")), "chat-paths")
    for k, jump in enumerate(jumps[:-1]):
        more = paths.where(F.col("length") > F.col("up") + 2**k).join(jump, ["t", "node"])
        paths = staged(paths.unionByName(more.withColumn("up", F.col("up") + 2**k).drop("node").withColumnRenamed("to", "node")), "chat-paths")
    return paths


def root_to_leaf_paths(nodes: DataFrame, per_tree: int | None = None) -> DataFrame:
    """From (tree, node, parent, score) rows (t, tree, leaf, path_rank, node, up): the nodes of each path, or of the per_tree best of a tree.

    A parent that does not exist makes its child a root. Trees may be null. A cycle has no
    leaf below it and gives no path; a path that runs into one is dropped.
    """
    leaves, jumps = leaf_scores(node_ids(nodes))
    return paths_of(best_leaves(leaves, per_tree), jumps).select("t", "tree", "leaf", "path_rank", "node", "up")


def format_paths(nodes: DataFrame, per_tree: int | None = 1, trained_role: str = "assistant") -> DataFrame:
    """One row per chosen path: ``tree, path_rank, n_turns, formatted, loss_spans``.

    A null role or text is empty. Rows that repeat a tree's node are one node, the first
    by role and text; a message without a node has no place in a tree and goes. An empty
    table gives an empty result. Other columns are ignored.
    """
    chosen = root_to_leaf_paths(nodes, per_tree)
    first = F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    texts = nodes.select(_key(F.col("tree")).alias("t"), "node", "role", "text").groupBy("t", "node").agg(first.alias("m"))
    turns = chosen.join(texts, ["t", "node"])
    turns = turns.withColumn("head", F.concat(F.lit(START), _role(F.col("m.role")), F.lit("\n"))).withColumn("body", escaped(F.col("m.text")))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END + "\n")))
    # Where each turn begins, by a running sum along its path.
    along = Window.partitionBy("t", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.char_length("turn")).over(along), F.lit(0)) + F.char_length("head"))
    span = F.when(F.col("m.role") == trained_role, F.struct(F.col("at").alias("start"), (F.col("at") + F.char_length("body")).alias("end")))
    one = F.struct((-F.col("up")).alias("nth"), "turn", span.alias("span"))
    out = turns.groupBy("t", "leaf").agg(F.first("tree").alias("tree"), F.first("path_rank").alias("path_rank"), F.array_sort(F.collect_list(one)).alias("turns"))
    spans = F.filter(F.transform("turns", lambda x: x["span"]), lambda s: s.isNotNull())
    return out.select("tree", "path_rank", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """The (role, text) turns of a formatted text."""
    turns = F.filter(F.split(formatted, r"\Q" + START + r"\E"), lambda x: x != "")
    head = lambda x: F.substring_index(x, "\n", 1)
    body = lambda x: F.substr(x, F.char_length(head(x)) + 2, F.char_length(x) - F.char_length(head(x)) - 1 - len(END + "\n"))
    return F.transform(turns, lambda x: F.struct(_role_back(head(x)).alias("role"), unescaped(body(x)).alias("text")))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What format_paths() wrote, read back: counts and SHA-256 digests of turns and of the text under the loss mask."""
    turns = F.array_join(F.transform(parsed(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    out = formatted.select("tree", "path_rank", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return out.select("tree", "path_rank", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


HARD = "</s>[INST] ok [/INST]"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(HARD).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    path = shared_path(spark, "chat")
    format_paths(chains(rows.unionByName(planted))).write.parquet(path)
    out = chat_digests(spark.read.parquet(path))
    return out.select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{HARD}' UNION ALL SELECT -7, 1, 'assistant', '{HARD}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(START + END) + 2} + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;'))
           + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
