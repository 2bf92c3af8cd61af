"""Import and call graph of modules: edges, reach, unused names, cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.tables import written
from recollect.functions.text import split_words


def module_of(file_path: str = "file_path"):
    """Base name of a path without extension."""
    return F.regexp_extract(file_path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def extract_imports(chunks: DataFrame) -> DataFrame:
    """Distinct (file_path, module, kind, line): the first chunk of a file with the import says its line."""
    lines = chunks.select("file_path", "start_line", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*((?:from|import)\s+[\w.]+)"), F.lit(1))).alias("said"))
    each = lines.select("file_path", F.regexp_extract("said", r"\s([\w.]+)$", 1).alias("module"), F.when(F.col("said").startswith("from"), "from").otherwise("direct").alias("kind"), F.col("start_line").alias("line"))
    return each.groupBy("file_path", "module").agg(F.min(F.struct("line", "kind")).alias("x")).select("file_path", "module", "x.kind", "x.line")


def find_importers(chunks: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, file_path, line): files with a chunk that holds `import ` and the module's last segment as a substring, by
    design also where it is part of another word. Distinct tokens meet the segments by their first characters, and are compared
    then; blank modules match nothing."""
    text = F.lower("content")
    holding = chunks.where(F.contains(text, F.lit("import "))).select("file_path", "start_line", F.explode(F.array_distinct(split_words(text))).alias("token"))
    first = holding.groupBy("token", "file_path").agg(F.min("start_line").alias("line"))
    wanted = modules.select("module", F.lower(F.element_at(F.split("module", r"\."), -1)).alias("tail")).where("tail <> ''").withColumn("gram", F.substring("tail", 1, 2))
    places = F.sequence(F.lit(1), F.length("token"))
    tokens = first.select("token").distinct().withColumn("gram", F.explode(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(F.substring("token", i, 1), F.substring("token", i, 2)))))))
    met = tokens.join(wanted.hint("merge"), "gram").where(F.contains("token", F.col("tail"))).select("token", "module").distinct()
    return first.join(met.hint("merge"), "token").groupBy("module", "file_path").agg(F.min("line").alias("line"))


def call_edges(chunks: DataFrame) -> DataFrame:
    """(file_path, caller, target, line) of the calls of each chunk."""
    return chunks.select("file_path", F.col("name").alias("caller"), F.explode("calls").alias("c")).select("file_path", "caller", "c.target", "c.line")


def called_by(chunks: DataFrame) -> DataFrame:
    """(module, file_path, caller, target): calls from other files into a module, by the target's first segment."""
    e = call_edges(chunks).withColumn("module", F.element_at(F.split("target", r"\."), 1))
    own = chunks.select(module_of().alias("module")).distinct()
    return e.join(own.hint("merge"), "module").where(module_of() != F.col("module")).select("module", "file_path", "caller", "target")


def dependency_graph(chunks: DataFrame) -> DataFrame:
    """Of each file: modules imported, those of them that are no file's (external), files that import it, targets called, callers
    from other files, functions that nothing calls; and the numbers of calls and of these functions."""
    files = chunks.select("file_path", module_of().alias("module")).distinct()
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    i = extract_imports(chunks)
    own = files.select("module").distinct()
    outside = i.join(own.hint("merge"), "module", "left_anti").groupBy("file_path").agg(text("module").alias("external"))
    imports = i.groupBy("file_path").agg(text("module").alias("imports"))
    back = i.groupBy("module").agg(text("file_path").alias("imported_by"))
    out = call_edges(chunks).groupBy("file_path").agg(F.count("*").alias("calls_to"), text("target").alias("callees"))
    into = called_by(chunks).groupBy("module").agg(F.count("*").alias("called_by"), text(F.concat_ws(":", "file_path", "caller")).alias("callers"))
    unused = unused_functions(chunks).groupBy("file_path").agg(F.count("*").alias("unused"), text("name").alias("unused_names"))
    joined = files.join(imports.hint("merge"), "file_path", "left").join(back.hint("merge"), "module", "left").join(out.hint("merge"), "file_path", "left").join(into.hint("merge"), "module", "left").join(unused.hint("merge"), "file_path", "left").join(outside.hint("merge"), "file_path", "left")
    return joined.select("file_path", *[F.coalesce(c, F.lit("")).alias(c) for c in ("imports", "external", "imported_by", "callees", "callers", "unused_names")], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("calls_to", "called_by", "unused")])


def unused_functions(chunks: DataFrame) -> DataFrame:
    """(file_path, name) of functions that no call of their file, and no call of another to their module, names."""
    own = chunks.where(F.col("type").isin("function", "method")).select("file_path", module_of().alias("module"), "name")
    inside = call_edges(chunks).select("file_path", F.regexp_replace("target", r"^self\.", "").alias("name")).distinct()
    outside = call_edges(chunks).select(F.regexp_extract("target", r"^([^.]+)\.", 1).alias("module"), F.regexp_extract("target", r"\.(.+)$", 1).alias("name")).where("module <> ''").distinct()
    return own.join(inside.hint("merge"), ["file_path", "name"], "left_anti").join(outside.hint("merge"), ["module", "name"], "left_anti").select("file_path", "name")


def usage_analysis(chunks: DataFrame) -> DataFrame:
    """(file_path, name, parameter) of parameters that a function's lines after its signature don't name."""
    p = chunks.select("file_path", "name", "content", F.explode("parameters").alias("parameter")).where(~F.col("parameter").isin("self", "cls"))
    body = F.regexp_extract("content", r"(?s)def [^\n]*\n(.*)$", 1)
    word = F.concat(F.lit(r"\b"), F.col("parameter"), F.lit(r"\b"))
    return p.where(~F.regexp_like(body, word)).select("file_path", "name", "parameter")


def defined_and_used(chunks: DataFrame) -> DataFrame:
    """(file_path, kind, name): of each file the functions defined, those that other files call (external), those that nothing
    calls (unused)."""
    own = chunks.where(F.col("type").isin("function", "method")).select("file_path", "name")
    calls = called_by(chunks).select("module", F.element_at(F.split("target", r"\."), -1).alias("name")).distinct()
    files = chunks.select("file_path", module_of().alias("module")).distinct()
    outside = calls.join(files.hint("merge"), "module").select("file_path", "name")
    kinds = {"defined": own, "external": outside, "unused": unused_functions(chunks)}
    return reduce(DataFrame.unionByName, [rows.select("file_path", F.lit(kind).alias("kind"), "name").distinct() for kind, rows in kinds.items()])


def transitive_imports(edges: DataFrame) -> DataFrame:
    """(u, v): edges and one more hop."""
    more = edges.select("u", F.col("v").alias("w")).join(edges.select(F.col("u").alias("w"), F.col("v")).hint("merge"), "w").select("u", "v")
    return edges.select("u", "v").unionByName(more).distinct()


def reachable(edges: DataFrame) -> DataFrame:
    """All pairs (u, v) with a path: paths double in length each round, so rounds go with the logarithm of the longest.

    The result itself is quadratic in what reaches what: for module graphs, not for graphs of documents.
    """
    pairs = written(edges.select("u", "v").distinct(), "reach")
    n = pairs.count()
    while True:
        more = pairs.select("u", F.col("v").alias("w")).join(pairs.select(F.col("u").alias("w"), "v").hint("merge"), "w").select("u", "v")
        pairs = written(pairs.unionByName(more).distinct(), "reach")
        n, before = pairs.count(), n
        if n == before:
            return pairs


def contracted(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(edges left, [(x, u, v) of each round]): nodes without a way in or out are taken off, and nodes with one way in and one out
    give way to a shortcut u -> v from the one to the other; all cycles stay, shorter.

    Of such nodes in a row those go whose hash of the round is less than those beside them: about a third of a chain or a ring, so
    that one of n nodes takes a logarithm of n rounds. Edges don't get more.
    """
    edges, rounds = written(edges.select("u", "v").distinct(), "contract"), []
    n = edges.count()
    while n:
        ends = edges.where("u <> v")
        into = ends.groupBy(F.col("v").alias("x")).agg(F.count("*").alias("i"), F.min("u").alias("u"))
        out = ends.groupBy(F.col("u").alias("x")).agg(F.count("*").alias("o"), F.min("v").alias("v"))
        loops = edges.where("u = v").select(F.col("u").alias("x"), F.lit(True).alias("loop"))
        nodes = into.join(out.hint("merge"), "x", "full").join(loops.hint("merge"), "x", "full")
        both = F.col("i").isNotNull() & F.col("o").isNotNull()
        kind = F.when(F.col("loop").isNotNull(), "stay").when(~both, "off").when((F.col("i") == 1) & (F.col("o") == 1), "chain").otherwise("stay")
        nodes = written(nodes.select("x", "u", "v", kind.alias("kind"), F.xxhash64(F.lit(len(rounds)), "x").alias("p")), "degrees")
        chain = nodes.where("kind = 'chain'").select("x", "u", "v", "p")
        near = chain.select(F.col("x").alias("y"), F.col("p").alias("q"))
        least = chain
        for side in ("u", "v"):  # less than the chain nodes on both sides, or than itself by name
            beside = near.withColumnRenamed("y", side).withColumnRenamed("q", f"q_{side}")
            least = least.join(beside.hint("merge"), side, "left")
        lower = lambda side: F.col(f"q_{side}").isNull() | (F.struct("p", "x") < F.struct(F.col(f"q_{side}"), F.col(side)))
        gone = written(least.where(lower("u") & lower("v")).select("x", "u", "v"), "shortcuts")
        off = gone.select("x").unionByName(nodes.where("kind = 'off'").select("x"))
        kept = edges.join(off.hint("merge"), F.col("u") == F.col("x"), "left_anti").join(off.hint("merge"), F.col("v") == F.col("x"), "left_anti")
        edges, before = written(kept.unionByName(gone.select("u", "v")).distinct(), "contract"), n
        rounds.append(gone)
        n = edges.count()
        if n == before:
            break
    return edges, rounds


def expanded(labels: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(node, cycle) of all nodes on cycles, from that of those that contraction left: a node that gave way to a shortcut is on a cycle
    if both ends of the shortcut are on the same."""
    for gone in reversed(rounds):
        if gone.isEmpty():
            continue
        ends = gone.join(labels.toDF("u", "cu").hint("merge"), "u").join(labels.toDF("v", "cv").hint("merge"), "v")
        labels = written(labels.unionByName(ends.where("cu = cv").select(F.col("x").alias("node"), F.col("cu").alias("cycle"))), "cycles")
    return labels


def spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, color): the least color that reaches a node along edges (u, v), from (node, color) of all nodes. A round hands
    colors on by one edge, and only the last of them that have changed."""
    now, fresh = written(start, "colors"), None
    while fresh is None or not fresh.isEmpty():
        sent = (now if fresh is None else fresh).join(edges.hint("merge"), F.col("node") == F.col("u")).groupBy(F.col("v").alias("__n")).agg(F.min("color").alias("__c"))
        both = now.join(sent.hint("merge"), F.col("node") == F.col("__n"), "left")
        both = written(both.select("node", F.least("color", "__c").alias("color"), (F.col("__c").isNotNull() & (F.col("color").isNull() | (F.col("__c") < F.col("color")))).alias("changed")), "colors")
        now, fresh = both.select("node", "color"), both.where("changed").select("node", "color")
    return now


#: Nodes on cycles up to which pairs of them are listed, as that takes fewer rounds; with more, colors are spread.
PAIRED = 1000


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, cycle, size) of the nodes on a cycle of edges (u, v): cycle is the least node of a strongly connected component. An edge
    from a node to itself is a cycle.

    The graph is contracted first, so that rounds go with the logarithm of its chains. Of a few nodes that are left all paths are
    listed. Of more, each node takes the least node that reaches it as its color; what reaches that node back within its color is
    a component, which is taken out; and again, until no edge is left: tables have a row for each node or edge. Both
    give the same rows. Nodes that gave way get their components back, round by round.
    """
    found: list[DataFrame] = []
    edges, rounds = contracted(edges)
    loops = [edges.where("u = v").select(F.col("u").alias("node"))]
    if edges.select("u").distinct().limit(PAIRED + 1).count() <= PAIRED:
        reach = reachable(edges)
        both = reach.join(reach.select(F.col("v").alias("u"), F.col("u").alias("v")).hint("merge"), ["u", "v"])
        labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("cycle")), "components")
    else:
        while not edges.isEmpty():
            nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
            colors = spread(nodes.withColumn("color", F.col("node")), edges)
            ends = edges.join(colors.toDF("u", "cu").hint("merge"), "u").join(colors.toDF("v", "cv").hint("merge"), "v")
            inside = written(ends.where("cu = cv").select(F.col("v").alias("u"), F.col("u").alias("v")), "same-color")  # turned round
            # backwards from each color's own node: it is the least of its color, so it spreads to all that reach it
            back = spread(colors.select("node", F.when(F.col("node") == F.col("color"), F.col("color")).alias("color")), inside)
            part = written(back.where("color is not null").join(colors.toDF("node", "own").hint("merge"), "node").where("color = own").select("node", F.col("own").alias("cycle")), "component")
            found.append(part)
            gone = part.select("node")
            left = edges.join(gone.hint("merge"), F.col("u") == F.col("node"), "left_anti").join(gone.hint("merge"), F.col("v") == F.col("node"), "left_anti")
            edges, more = contracted(left)
            rounds += more
            loops.append(edges.where("u = v").select(F.col("u").alias("node")))
        every = written(reduce(DataFrame.unionByName, found), "components")
        # a node alone is on a cycle only by an edge to itself
        many = every.groupBy("cycle").agg(F.count("*").alias("n")).where("n > 1").select("cycle")
        labels = written(every.join(many.hint("merge"), "cycle", "left_semi").unionByName(every.join(many.hint("merge"), "cycle", "left_anti").join(reduce(DataFrame.unionByName, loops).distinct().hint("merge"), "node", "left_semi").select("cycle", "node")).select("node", "cycle"), "components")
    every = expanded(labels, rounds)
    least = every.groupBy("cycle").agg(F.min("node").alias("least"), F.count("*").alias("size"))
    return every.join(least.hint("merge"), "cycle").select("node", F.col("least").alias("cycle"), "size")


def circular_dependencies(edges: DataFrame) -> DataFrame:
    """(node, cycle, size) of nodes on a cycle: cycle is the least node of the strongly connected component."""
    return strong_components(edges)


def dependency_kind(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: modules (module), those of them on a cycle, and whether the graph is a DAG or a DCG."""
    on = strong_components(edges).agg(F.count("*").alias("on_cycles"))
    kind = F.when(F.col("on_cycles") > 0, "DCG").otherwise("DAG")
    return modules.agg(F.countDistinct("module").alias("modules")).crossJoin(F.broadcast(on)).withColumn("kind", kind)  # one row each
