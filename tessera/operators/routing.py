"""Scores of nodes by the facets of a question, rule tables, lookups with gates, and routes over typed graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ranges
from tessera.session import cut

#: Tables of asked terms are sent to all tasks up to this number of rows, by count.
SENT_ROWS = 1_000_000


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def facet_scores(nodes: DataFrame, questions: DataFrame, query: str = "q", node: str = "node", without: tuple[str, ...] = T.STOP, conditions: str | None = None) -> DataFrame:
    """``(query, node, score)`` of the nodes that share a term with a question's facets.

    ``questions`` is ``(query, question, cases array<string>)``, ``nodes`` is ``(node,
    text, headings, path, identity, key, case)``.  Whole identifiers of a question
    weigh 2, their pieces 1; the share of this weight that the text has counts 30,
    that of the headings 8, the share of CJK terms 8.  An identity or a key that is
    an identifier adds 4 each, a path that has one 2, one of the named cases 4.
    Where cases are named, nodes of others are left out.  Nulls match nothing.
    ``conditions`` names a column of texts of which up to two of the question's
    terms add 1 each; a node is not found by them alone.
    """
    stops = F.array(*map(F.lit, without)).cast("array<string>")
    ids = T.identifiers(F.col("question"), list(without))
    words = F.array_distinct(F.concat(F.array_except(T.tokens(F.col("question")), stops), ids))
    coded = questions.select(query, F.coalesce("cases", F.array().cast("array<string>")).alias("cases"), ids.alias("_ids"), words.alias("_w"))
    asked = coded.select(query, "_ids", F.explode("_w").alias("term")).select(
        query, "term", F.when(F.array_contains("_ids", F.col("term")), 2).otherwise(1).alias("weight"), F.col("term").rlike(r"\A[\x00-\x7f]*\z").alias("latin")
    )
    totals = asked.groupBy(query).agg(F.sum(F.when(F.col("latin"), F.col("weight")).otherwise(0)).alias("_all"), F.count_if(~F.col("latin")).alias("_cjk"))
    facts = coded.select(query, "cases").join(totals, query)

    one = lambda c: F.array(F.lower(F.coalesce(c, F.lit(""))))
    channels = {"body": F.array_distinct(T.tokens(F.col("text"))), "head": F.array_distinct(T.tokens(F.col("headings"))), "path": F.array_distinct(T.tokens(F.col("path"))), "identity": one(F.col("identity")), "key": one(F.col("key"))}
    if conditions is not None:
        channels["condition"] = F.array_distinct(T.tokens(F.col(conditions)))
    tag = lambda n, a: F.transform(a, lambda x: F.struct(F.lit(n).alias("channel"), x.alias("term")))
    tagged = F.flatten(F.array(*[tag(n, a) for n, a in channels.items()]))
    held = nodes.select(node, "case", F.inline(tagged)).join(_sent(asked), "term")

    at = lambda n, more: (F.col("channel") == n) & more
    weight = lambda n: F.sum(F.when(at(n, F.col("latin")), F.col("weight")).otherwise(0))
    named = lambda n: F.max(at(n, F.col("weight") == 2).cast("int"))
    met = held.groupBy(query, node, "case").agg(weight("body").alias("_b"), weight("head").alias("_h"), F.count_if(at("body", ~F.col("latin"))).alias("_c"), F.count_if(F.col("channel") == "condition").alias("_condition"), *[named(n).alias(f"_{n}") for n in ("path", "identity", "key")])
    inside = F.coalesce(F.array_contains("cases", F.col("case")), F.lit(False))
    open_ = (F.size("cases") == 0) | F.col("case").isNull() | inside
    score = (30.0 * F.col("_b") + 8.0 * F.col("_h")) / F.greatest(F.lit(1), "_all") + 8.0 * F.col("_c") / F.greatest(F.lit(1), "_cjk")
    score = score + 4 * F.col("_identity") + 4 * F.col("_key") + 2 * F.col("_path") + F.when(inside, 4).otherwise(0) + F.least(F.lit(2), "_condition")
    found = met.where(F.col("_b") + F.col("_h") + F.col("_c") + F.col("_path") > 0).join(_sent(facts), query).where(open_)
    return found.select(query, node, F.round(score, 6).alias("score"))


def condition_bonus(questions: DataFrame, edges: DataFrame, query: str, conditions: str = "conditions", most: int = 3) -> DataFrame:
    """``(query, source, target, relation, plus)``: how many of a question's terms an edge's conditions have, ``most`` at most; edges with none are left out."""
    asked = questions.select(query, F.explode(T.terms(F.col("question"))).alias("term"))
    held = edges.select("source", "target", "relation", F.explode(T.terms(F.col(conditions))).alias("term"))
    met = held.join(_sent(asked), "term").groupBy(query, "source", "target", "relation").agg(F.count_distinct("term").alias("plus"))
    return met.select(query, "source", "target", "relation", F.least(F.lit(most), "plus").alias("plus"))


def ablated(nodes: DataFrame, edges: DataFrame, variant: str, conditions: str = "conditions") -> tuple[DataFrame, DataFrame, int | None]:
    """Nodes, edges and depth (None: as given) of a variant: ``full``, ``no_cross``, ``no_conditions`` or ``no_extension``."""
    if variant not in ("full", "no_cross", "no_conditions", "no_extension"):
        raise ValueError(f"no such variant: {variant}")
    none = F.lit(None).cast("string")
    if variant == "no_conditions":
        nodes, edges = (df.withColumn(conditions, none) if conditions in df.columns else df for df in (nodes, edges))
    return nodes, edges.where(~F.coalesce("cross", F.lit(False))) if variant == "no_cross" else edges, 0 if variant == "no_extension" else None


def routes(seeds: DataFrame, edges: DataFrame, rules: DataFrame, query: str, depth: int = 3, beam: int = 32, bonus: DataFrame | None = None) -> DataFrame:
    """Best route to each node: ``(query, node, score, hop, origin, route)``; no route meets a node twice.

    ``rules`` is ``(relation, factor, bonus, cross_bonus, backward)``: a step's score is
    ``score * factor`` and the bonus, ``cross_bonus`` where the edge is ``cross``; edges of
    relations that aren't ``backward`` are taken forward only, others are no
    steps.  Of equal scores the least route stays.  At each hop the ``beam`` best go on,
    and a node counts again only with a strictly greater score.  ``bonus (query, source,
    target, relation, plus)`` adds to a step for one query.
    """
    typed = edges.join(F.broadcast(rules), "relation").withColumn("_plus", F.when(F.col("cross"), F.col("cross_bonus")).otherwise(F.col("bonus")))  # one row a relation
    named = ["relation", F.col("source").alias("_s"), F.col("target").alias("_t")]
    ahead = typed.select(F.col("source").alias("node"), "target", "factor", "_plus", *named)
    back = typed.where("backward").select(F.col("target").alias("node"), F.col("source").alias("target"), "factor", "_plus", *named)
    steps = cut(ahead.unionByName(back))
    more = None if bonus is None else cut(bonus.select(query, "relation", F.col("source").alias("_s"), F.col("target").alias("_t"), "plus"))
    best = seeds.select(query, "node", "score", F.lit(0).alias("hop"), F.array("node").alias("visited"))
    frontier = best
    for hop in range(1, depth + 1):
        wide = Window.partitionBy(query).orderBy(F.desc("score"), "node")
        going = frontier.withColumn("_r", F.row_number().over(wide)).where(F.col("_r") <= beam)
        met = going.join(steps, "node").where(~F.array_contains("visited", F.col("target")))
        if more is not None:
            met = met.join(more, [query, "relation", "_s", "_t"], "left").withColumn("_plus", F.col("_plus") + F.coalesce("plus", F.lit(0)))
        met = met.select(
            query, F.col("target").alias("node"), F.round(F.col("score") * F.col("factor") + F.col("_plus"), 9).alias("score"), F.concat("visited", F.array("target")).alias("visited")
        )
        first = met.groupBy(query, "node").agg(F.min(F.struct((-F.col("score")).alias("s"), F.array_join("visited", ">").alias("t"), "visited")).alias("_m"))
        known = best.select(query, "node", F.col("score").alias("old"))
        new = first.select(query, "node", (-F.col("_m.s")).alias("score"), F.lit(hop).alias("hop"), F.col("_m.visited").alias("visited"))
        frontier = cut(new.join(known, [query, "node"], "left").where("old is null or score > old").select(query, "node", "score", "hop", "visited"))
        both = best.unionByName(frontier).groupBy(query, "node").agg(F.max_by(F.struct("score", "hop", "visited"), F.struct("score", -F.col("hop"))).alias("_m"))
        best = cut(both.select(query, "node", "_m.score", "_m.hop", "_m.visited"))
    return best.select(query, "node", "score", "hop", F.get("visited", F.lit(0)).alias("origin"), F.array_join("visited", ">").alias("route"))


def neighbourhood(seeds: DataFrame, edges: DataFrame, query: str, depth: int = 2) -> DataFrame:
    """``(query, node, distance, degree)`` of the nodes within ``depth`` steps of a query's seeds, edges taken both ways."""
    ways = cut(edges.select(F.col("source").alias("node"), "target").unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("target"))).distinct())
    seen = seeds.select(query, "node", F.lit(0).alias("distance")).distinct()
    front = seen
    for distance in range(1, depth + 1):
        next_ = front.join(ways, "node").select(query, F.col("target").alias("node")).distinct()
        front = cut(next_.join(seen.select(query, "node"), [query, "node"], "left_anti").withColumn("distance", F.lit(distance)))
        seen = seen.unionByName(front)
    degrees = ways.groupBy("node").agg(F.count("*").alias("degree"))
    return seen.join(degrees, "node", "left").select(query, "node", "distance", F.coalesce("degree", F.lit(0)).alias("degree"))


def referred(ranked: DataFrame, references: DataFrame, asked: DataFrame, query: str, unit: str, top: int = 8, high: float = 0.88, low: float = 0.65) -> DataFrame:
    """``ranked (query, unit, score)`` with what its ``top`` best units refer to; the higher score of a unit stays.

    ``references`` is ``(unit, target, key)``; a target has ``high`` of the score where
    its key is among ``asked (query, key)``, else ``low``.
    """
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), unit))
    best = ranked.select(query, unit, "score").withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")
    led = best.join(references.select(unit, "target", "key"), unit).join(asked.select(query, "key").distinct().withColumn("_a", F.lit(True)), [query, "key"], "left")
    more = led.select(query, F.col("target").alias(unit), (F.col("score") * F.when(F.col("_a"), high).otherwise(low)).alias("score"))
    return ranked.select(query, unit, "score").unionByName(more).groupBy(query, unit).agg(F.round(F.max("score"), 9).alias("score"))


def rule_scores(requests: DataFrame, candidates: DataFrame, rules: list[dict], request: str, candidate: str, keep: int = 10) -> DataFrame:
    """The ``keep`` best candidates of each request by a table of rules: ``(request, candidate, score, place)``.

    A rule ``{any, wants, without, weight}`` holds of a request whose ``text`` has one of
    ``any``, and of a candidate whose ``text`` has one of ``wants`` and none of
    ``without``, in any case; the score is the sum of the weights of rules that hold of both.  Ties by candidate.
    Only scores above 0 count.

    Requests and candidates are compared as classes of the rules that hold of
    them: of a class of candidates no more than its ``keep`` first can be among the
    best, so no pair of a request and a candidate is formed beyond these.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    has = lambda phrases: F.exists(F.array(*[F.lit(p.lower()) for p in phrases]).cast("array<string>"), lambda p: F.contains(low, p))
    held = lambda cs: F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(cs)]), lambda x: x.isNotNull())
    fired = requests.select(request, held([has(r["any"]) for r in rules]).alias("fired")).where(F.size("fired") > 0)
    match = candidates.select(candidate, held([has(r["wants"]) & ~has(r.get("without", [])) for r in rules]).alias("match")).where(F.size("match") > 0)
    first = match.withColumn("_n", F.row_number().over(Window.partitionBy("match").orderBy(candidate))).where(F.col("_n") <= keep).drop("_n")
    weights = F.array(*[F.lit(float(r["weight"])) for r in rules])
    ask, offer = fired.select("fired").distinct(), first.select("match").distinct()
    pairs = ask.select("fired", F.explode("fired").alias("rule")).join(offer.select("match", F.explode("match").alias("rule")), "rule")
    scored = pairs.groupBy("fired", "match").agg(F.sum(F.get(weights, F.col("rule"))).alias("score")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("fired").orderBy(F.desc("score"), candidate))
    best = scored.join(first, "match").withColumn("place", place).where(F.col("place") <= keep)
    return fired.join(best, "fired").select(request, candidate, "score", "place")


#: Names that have a term up to which requests meet names by it at once.
RARE = 1_000


def _most_terms(requests: DataFrame, names: DataFrame, request: str, name: str) -> DataFrame:
    """``(request, name)``: of each request's ``text`` the name that shares most terms with it, the least of several.

    Requests meet names by rare terms first.  Frequent terms alone can't do better
    than as many as they are, so only requests that have at least as many of them
    as the best found shares meet names by these too.
    """
    words = cut(names.select(name).distinct().select(name, F.explode(T.terms(F.col(name))).alias("_t")), "name-terms")
    held = words.groupBy("_t").agg(F.count("*").alias("_d"))
    asked = cut(requests.select(request, F.explode(T.terms(F.col("text"))).alias("_t")).join(held, "_t"), "request-terms")
    best = lambda pairs: pairs.groupBy(request).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(name).alias("name"))).alias("_m"))
    met = asked.where(F.col("_d") <= RARE).join(words, "_t").select(request, name).distinct()
    counted = met.join(asked.select(request, "_t"), request).join(words, [name, "_t"]).groupBy(request, name).agg(F.count("*").alias("_n"))
    first = cut(best(counted), "resolved")
    often = asked.where(F.col("_d") > RARE).groupBy(request).agg(F.count("*").alias("_f"))
    again = often.join(first, request, "left").where(F.col("_f") >= F.coalesce(-F.col("_m.n"), F.lit(1))).select(request)
    rest = asked.join(again, request, "left_semi").join(words, "_t").groupBy(request, name).agg(F.count("*").alias("_n"))
    every = first.join(again, request, "left_anti").unionByName(best(rest))
    return every.select(request, F.col("_m.name").alias(name))


def resolved(requests: DataFrame, names: DataFrame, aliases: DataFrame, request: str, name: str = "name") -> DataFrame:
    """``(request, name, how)``: the name that a request's ``text`` is (``exact``), is an alias of (``alias``), or shares most terms with (``terms``).

    ``aliases`` is ``(alias, name)``; of several the least name.  Requests without any have nulls.
    """
    exact = requests.join(names.select(name).distinct(), requests["text"] == F.col(name)).select(request, name)
    alias = requests.join(aliases, requests["text"] == F.col("alias")).groupBy(request).agg(F.min(name).alias(name))
    ways = [df.select(request, F.struct(F.lit(k).alias("k"), F.col(name).alias("name"), F.lit(how).alias("how")).alias("_w")) for k, (how, df) in enumerate((("exact", exact), ("alias", alias)))]
    told = cut(ways[0].unionByName(ways[1]).groupBy(request).agg(F.min("_w").alias("_w")), "told")
    near = _most_terms(requests.join(told, request, "left_anti"), names, request, name)
    best = told.unionByName(near.select(request, F.struct(F.lit(2).alias("k"), F.col(name).alias("name"), F.lit("terms").alias("how")).alias("_w")))
    return requests.select(request).join(best, request, "left").select(request, F.col("_w.name").alias(name), F.col("_w.how").alias("how"))


def targets(requests: DataFrame, facts: DataFrame, request: str, key: str = "key", value: str = "value", fact: str = "fact") -> DataFrame:
    """``(request, status, fact)``: the fact of a request's key whose value is the same number, however it is written.

    ``unique`` with its fact, ``ambiguous`` where several have it, ``no_match``, or
    ``unsupported`` where the request's value is no number.
    """
    number = lambda c: c.try_cast("decimal(38,12)")
    asked = requests.select(request, key, number(F.col(value)).alias("_v"))
    known = facts.select(key, number(F.col(value)).alias("_v"), fact)
    # facts are counted before the join: a value that very many facts have is one row
    counted = known.where("_v is not null").groupBy(key, "_v").agg(F.count("*").alias("_n"), F.min(fact).alias(fact))
    status = F.when(F.col("_v").isNull(), "unsupported").when(F.col("_n").isNull(), "no_match").when(F.col("_n") > 1, "ambiguous").otherwise("unique")
    return asked.join(counted, [key, "_v"], "left").select(request, status.alias("status"), F.when(F.col("_n") == 1, F.col(fact)).alias(fact))


def rebuilt(old: DataFrame, new: DataFrame, key: str, digest: str = "sha256") -> DataFrame:
    """``(key, state)`` of what an incremental build does: ``parsed`` (new or changed), ``reused`` or ``deleted``."""
    a, b = old.select(key, F.col(digest).alias("_a")), new.select(key, F.col(digest).alias("_b"))
    state = F.when(F.col("_b").isNull(), "deleted").when(F.col("_a") == F.col("_b"), "reused").otherwise("parsed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def canonical(rows: DataFrame, id: str, digest: Column) -> DataFrame:
    """``(id, canonical, copies)``: the least id of the rows with the same content, and their number."""
    coded = rows.select(id, digest.alias("_h"))
    groups = coded.groupBy("_h").agg(F.min(id).alias("canonical"), F.count("*").alias("copies"))
    return coded.join(groups, "_h").select(id, "canonical", "copies")


def transitions(events: DataFrame, job: str, order: str, state: str, allowed: dict[str, tuple[str, ...]], chunk: int = 4096) -> DataFrame:
    """``(job, state, n_refused)``: the state a job ends in when steps that ``allowed`` does not name are refused.

    ``allowed`` gives the states that may follow each; a state without an entry is
    final.  A job's first event sets its state; a null state is the empty name; events of one place in the order go by name.

    A run of events is a map from the state before it to the state after it, and
    such maps compose: events are numbered without holding a job in one task, each
    ``chunk`` of them is folded once for every state it may begin in, and a job's
    chunks are then followed in order.
    """
    names = sorted({*allowed, *(s for v in allowed.values() for s in v)})
    after = F.create_map(*[x for k in names for x in (F.lit(k), F.array(*map(F.lit, allowed.get(k, ()))).cast("array<string>"))])
    rows = events.select(job, F.col(order).alias("_o"), F.coalesce(state, F.lit("")).alias("_s"))
    placed = ranges.numbered(rows, ["_o", "_s"], [job], "_place").withColumn("_chunk", F.floor((F.col("_place") - 1) / chunk))
    chunks = placed.groupBy(job, "_chunk").agg(F.array_sort(F.collect_list(F.struct("_place", "_s"))).alias("_e"))

    def step(acc: Column, e: Column) -> Column:
        ok = acc["s"].isNull() | F.coalesce(F.array_contains(F.try_element_at(after, acc["s"]), e["_s"]), F.lit(False))
        return F.struct(F.when(ok, e["_s"]).otherwise(acc["s"]).alias("s"), (acc["n"] + F.when(ok, F.lit(0)).otherwise(F.lit(1)).cast("long")).alias("n"))

    at = lambda s: F.struct(s.cast("string").alias("s"), F.lit(0).cast("long").alias("n"))
    ends = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.aggregate("_e", at(F.lit(k)), step) for k in names]))
    folded = chunks.select(job, "_chunk", F.aggregate("_e", at(F.lit(None)), step).alias("new"), ends.alias("ends"), F.size("_e").cast("long").alias("n"))

    def follow(acc: Column, c: Column) -> Column:
        known = F.try_element_at(c["ends"], acc["s"])
        on = F.when(acc["s"].isNull(), c["new"]).when(known.isNotNull(), known).otherwise(F.struct(acc["s"].alias("s"), c["n"].alias("n")))
        return F.struct(on["s"].alias("s"), (acc["n"] + on["n"]).alias("n"))

    whole = folded.groupBy(job).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("_chunk", "new", "n", F.map_entries("ends").alias("ends"))), lambda a, b: (a["_chunk"] - b["_chunk"]).cast("int")), at(F.lit(None)), lambda acc, c: follow(acc, F.struct(c["new"].alias("new"), c["n"].alias("n"), F.map_from_entries(c["ends"]).alias("ends")))).alias("_z"))
    return whole.select(job, F.col("_z.s").alias("state"), F.col("_z.n").alias("n_refused"))
