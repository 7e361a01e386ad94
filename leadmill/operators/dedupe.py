"""Entity resolution of raw leads: exact by domain, then by name and place without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions import normalize as nz
from leadmill.operators.namejoin import ANYWHERE, PARTNERS, similar_ids, spot
from leadmill.operators.ranking import ranked
from leadmill.session import checkpoint, discard, spread

RAW_FIELDS = {
    "name": "string", "website": "string", "industry": "string", "email": "string", "phone": "string",
    "city": "string", "state": "string", "country": "string", "employees": "bigint",
    "revenue": "bigint", "owner": "string", "title": "string", "linkedin": "string",
}
#: Parts that the rows of one (name, place) are dealt to when they learn their keeper.
SALTS = 32
FILLABLE = ["industry", "city", "state", "country", "employees", "revenue"]


def candidates(raw: DataFrame) -> DataFrame:
    """Raw rows with explicit and effective domain, shown name and name key."""
    out = raw.withColumns(
        {c: F.lit(None).cast(t) for c, t in RAW_FIELDS.items() if c not in raw.columns}
    )
    out = out.withColumn("explicit_domain", nz.canonical_domain("website"))
    out = out.withColumn("domain", F.coalesce("explicit_domain", nz.lead_domain(F.lit(None).cast("string"), "email")))
    out = out.withColumn("name", nz.lead_name("name", "domain"))
    return out.withColumn("name_key", nz.company_name_key("name"))


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def _first(c: str, order: Column) -> Column:
    """First non-empty value in order: what filling the kept row one duplicate at a time gives."""
    return F.min_by(c, F.when(_present(c), order)).alias(c)


def known_domains(cands: DataFrame, companies: DataFrame) -> DataFrame:
    """Domains looked up as existing: only those written out in some row of the batch."""
    asked = cands.filter("explicit_domain IS NOT NULL").select(F.col("explicit_domain").alias("domain")).distinct()
    return companies.filter("domain IS NOT NULL").select("domain").join(spread(asked), "domain", "left_semi").distinct()


def exact_decisions(cands: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """Candidates with ``decision`` (no_identity, existing, keep, exact, open) and, where
    decided, the keeper's seq. ``open`` rows have no domain and go to the name pass."""
    # rows without a domain meet nobody: they bypass the joins
    out = cands.filter("domain IS NOT NULL")
    if companies is None:
        out = out.withColumn("_known", F.lit(False))
    else:
        known = known_domains(cands, companies).withColumn("_known", F.lit(True))
        out = out.join(spread(known), "domain", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    first = out.filter("NOT _known").groupBy("domain").agg(F.min("seq").alias("_first"))
    out = out.join(spread(first), "domain", "left").unionByName(
        cands.filter("domain IS NULL").withColumns({"_known": F.lit(False), "_first": F.lit(None).cast(first.schema["_first"].dataType)})
    )
    decision = (
        F.when(F.col("domain").isNull() & (F.col("name_key") == ""), "no_identity")
        .when(F.col("_known"), "existing")
        .when(F.col("domain").isNull(), "open")
        .when(F.col("seq") == F.col("_first"), "keep")
        .otherwise("exact")
    )
    keeper = F.when(F.col("domain").isNotNull() & ~F.col("_known"), F.col("_first"))
    return out.withColumns({"decision": decision, "keeper": keeper}).drop("_known", "_first")


def merged_leads(decided: DataFrame) -> DataFrame:
    """One row per keeper with gaps filled from its duplicates and the number folded in.

    Domain duplicates are folded before fuzzy ones, each in row order. All of it is one
    aggregation with map-side combine, so a domain with a third of all rows is no burden.
    """
    live = decided.filter("keeper IS NOT NULL")
    order = F.struct((F.col("decision") == "fuzzy").alias("late"), F.col("seq").alias("seq"))
    return live.groupBy(F.col("keeper").alias("seq")).agg(
        F.min_by("name", order).alias("name"),
        F.min_by("name_key", order).alias("name_key"),
        F.min_by("domain", order).alias("domain"),
        *[_first(c, order) for c in FILLABLE],
        (F.count("*") - 1).alias("merged_count"),
        F.bool_or(F.col("decision") == "fuzzy").alias("fuzzy_merged"),
    )


def contact_seeds(decided: DataFrame) -> DataFrame:
    """Contacts of the keepers: empty ones skipped, the first per (e-mail, name, phone)."""
    rows = decided.filter("keeper IS NOT NULL").select(
        F.col("keeper").alias("company_seq"), "seq", (F.col("decision") == "fuzzy").alias("late"),
        F.col("owner").alias("full_name"), "title", "email", "phone", "linkedin",
    )
    filled = F.lit(False)
    for c in ("full_name", "email", "phone", "linkedin"):
        filled = filled | _present(c)

    def norm(c, fold=True):
        t = F.coalesce(c, F.lit(""))
        return F.lower(t) if fold else t

    keyed = rows.filter(filled).groupBy(
        "company_seq", norm("email").alias("k1"), norm("full_name").alias("k2"), norm("phone", False).alias("k3")
    )
    return keyed.agg(
        F.min_by(F.struct("full_name", "title", "email", "phone", "linkedin", "late", "seq"),
                 F.struct("late", "seq")).alias("c")
    ).select("company_seq", "c.*")


# ---- name pass ------------------------------------------------------------


def _nodes(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keepers with a domain, groups of open rows) as (node, late, name, place).

    Open rows of equal name and place always end at the same keeper, so one row, the first,
    stands for all of them: a name copied over a third of the table is one node. Of kept
    rows with equal name and known place only the first can ever be matched.
    """
    token = nz.sorted_tokens("name_key")
    kept = merged_leads(decided.filter("decision IN ('keep', 'exact')")).filter("name_key <> ''")
    kept = kept.select("seq", token.alias("name"), nz.place_key("city").alias("place"))
    placed = kept.filter("place IS NOT NULL").groupBy("name", "place").agg(F.min("seq").alias("node"))
    anywhere = kept.filter("place IS NULL").select("name", "place", F.col("seq").alias("node"))
    firm = placed.unionByName(anywhere).withColumn("late", F.lit(False))
    opened = (
        decided.filter("decision = 'open'")
        .groupBy(token.alias("name"), nz.place_key("city").alias("place"))
        .agg(F.min("seq").alias("node"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _salt())).alias("salts"))
        .withColumn("late", F.lit(True))
    )
    return firm, opened


def _salt() -> Column:
    return F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int")


def _queues(loose: DataFrame, both: DataFrame, opened: DataFrame) -> DataFrame:
    """(q, at, u): the kept rows without a place, numbered in row order under their name.

    Every open group with a place that looks at such a row looks at all rows of that name, the first one first. So the rows
    of a name that have taken a place are always its first ones, and one place in the line stands for the whole list.
    """
    asked = both.join(spread(opened.select("name").distinct()), "name", "left_semi").select(F.col("other").alias("name")).distinct()
    numbered = ranked(loose.join(spread(asked), "name", "left_semi"), ["name"], [F.col("node").asc()], "at")
    return checkpoint(numbered.select(F.col("name").alias("q"), "at", F.col("node").alias("u")))


#: What a node is looked up by, next to its name: its place, that it has none, that it is an open group at all.
AT, NOWHERE, ALL = "=", "", "*"


def _met(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, v_place, u, u_late, u_place): the nodes of similar or equal names that have the same place, and open groups of which one has none.

    Each pair of nodes is found once, from the name ``a``; the later open group of the two becomes ``v``.
    """
    place = F.concat(F.lit(AT), "x_place")
    spots = (
        F.when(F.col("x_place").isNull(), F.array(F.lit(ALL)))
        .when(F.col("x_late") & (F.col("b_spots") == F.lit(ANYWHERE)), F.array(place, F.lit(NOWHERE)))
        .otherwise(F.array(place))
    )
    x = nodes.select(F.col("name").alias("a"), F.col("place").alias("x_place"), F.col("node").alias("x"), F.col("late").alias("x_late"))
    asking = pairs.join(spread(x), "a").select("a", "b", "x_place", "x", "x_late", F.explode(spots).alias("spot"))
    at = F.concat(F.lit(AT), "place")
    found = F.when(~F.col("late"), F.array(at)).when(F.col("place").isNull(), F.array(F.lit(NOWHERE), F.lit(ALL))).otherwise(F.array(at, F.lit(ALL)))
    y = nodes.select(F.col("name").alias("b"), F.col("place").alias("y_place"), F.col("node").alias("y"), F.col("late").alias("y_late"), F.explode(found).alias("spot"))
    met = asking.join(spread(y), ["b", "spot"])
    # of two open groups the later one, of an open group and a kept row the group
    first = F.col("x_late") & (~F.col("y_late") | (F.col("x") > F.col("y")))
    met = met.filter((F.col("x_late") | F.col("y_late")) & ((F.col("a") != F.col("b")) | first) & (~F.col("x_late") | ~F.col("y_late") | (F.col("x") != F.col("y"))))

    def side(c: str, one: str, other: str) -> Column:
        return F.when(first, F.col(one)).otherwise(F.col(other)).alias(c)

    return met.select(side("v", "x", "y"), side("v_place", "x_place", "y_place"), side("u", "y", "x"), side("u_late", "y_late", "x_late"), side("u_place", "y_place", "x_place"))


def candidate_edges(firm: DataFrame, opened: DataFrame, partners: int = PARTNERS) -> tuple[DataFrame, DataFrame | None]:
    """(v, v_place, u, u_late, u_place, q, at): open group v may match the earlier node u; and the queues (None if empty).

    Kept rows without a place are not listed one by one: a group with a place has one edge to the queue ``q`` of each
    similar name, which stands at its ``at``-th row, and a group without a place only meets the first of them.
    Names go by a number from here on, and only names that may have a place in common are paired.
    """
    columns = ["name", "place", "node", "late"]
    nodes = checkpoint(firm.select(columns).unionByName(opened.select(columns)))
    names = nodes.groupBy("name").agg(F.bool_or("late").alias("cand"), F.bit_or(spot(F.col("place"))).alias("spots"))
    # numbered once: another run of a lost task would number them otherwise
    names = checkpoint(names.withColumn("id", F.monotonically_increasing_id()))
    nodes = checkpoint(nodes.join(spread(names.select("name", "id")), "name").drop("name").withColumnRenamed("id", "name"))
    firm, opened = nodes.filter("NOT late"), nodes.filter("late")
    found = checkpoint(similar_ids(names, partners))
    same = names.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("spots").alias("b_spots"))
    edges = _met(found.unionByName(same), firm.filter("place IS NOT NULL").unionByName(opened))
    edges = edges.withColumns({"q": F.lit(None).cast("bigint"), "at": F.lit(None).cast("int")})
    if firm.isEmpty():
        return edges, None
    both = found.select(F.col("a").alias("name"), F.col("b").alias("other")).unionAll(found.select("b", "a")).unionAll(same.select("a", "b"))
    loose = firm.filter("place IS NULL")
    queues = None if loose.isEmpty() else _queues(loose, both, opened)
    v = opened.select("name", F.col("place").alias("v_place"), F.col("node").alias("v"))
    # an open group without a place meets the first kept row of a name
    first = firm.groupBy(F.col("name").alias("other")).agg(F.min_by(F.struct("place", "node"), "node").alias("f")).select(
        "other", F.col("f.place").alias("u_place"), F.col("f.node").alias("u"), F.lit(False).alias("u_late"),
        F.lit(None).cast("bigint").alias("q"), F.lit(None).cast("int").alias("at"),
    )
    kinds = [(v.filter("v_place IS NULL"), first)]
    if queues is not None:
        heads = queues.filter("at = 1").select(
            F.col("q").alias("other"), F.lit(None).cast("string").alias("u_place"), "u", F.lit(False).alias("u_late"), "q", "at"
        )
        kinds.append((v.filter("v_place IS NOT NULL"), heads))
    for groups, kept in kinds:
        edges = edges.unionByName(both.join(spread(kept), "other").join(spread(groups), "name").select(edges.columns))
    return edges, queues


#: An edge that stands at the head of its queue; a choice whose group has no other edge left.
HEAD = "q IS NOT NULL AND u_city IS NULL AND NOT u_gone"
ONLY_HEAD = "live = 1 AND heads = 1"


def _judged(state: DataFrame) -> DataFrame:
    """Edges with ``verdict``: whether ``u`` is a match (yes, no, unknown), as far as is known now."""
    # only kept rows without a place are claimed by the earliest group that waits
    free = ~F.col("u_open") & ~F.col("u_gone") & F.col("u_city").isNull() & F.col("v_place").isNotNull()
    claimed = state.filter(free)
    first = claimed.groupBy("u").agg(F.min("v").alias("first"))
    verdict = (
        F.when(F.col("u_gone"), "no")
        .when(F.col("u_open"), "unknown")
        .when(F.col("v_place").isNull() | (F.col("u_city") == F.col("v_place")), "yes")
        .otherwise("no")
    )
    turn = F.when(F.col("first") == F.col("v"), "yes").otherwise("unknown")
    return state.filter(~free).withColumn("verdict", verdict).unionByName(
        claimed.join(spread(first), "u").withColumn("verdict", turn).select(*state.columns, "verdict")
    )


def _choices(judged: DataFrame) -> DataFrame:
    """Per group: its edges left (``live``, of which ``plain`` and ``heads``), the first of them (``u``, ``late``), whether that is
    a certain match (``yes``), and the first certain match (``stop``, ``stop_late``). All from numbers, so that groups are hashed."""
    live, sure, late = F.col("verdict") != "no", F.col("verdict") == "yes", F.col("u_late")
    # the outcome of such an edge hangs on nothing but whether ``u`` is kept
    plain = F.col("u_open") & ~F.col("u_gone") & (F.col("v_place").isNull() | F.coalesce(F.col("u_city") == F.col("v_place"), F.lit(False)))
    heads = F.expr(HEAD) if "q" in judged.columns else F.lit(False)
    found = judged.groupBy("v").agg(
        *[F.min(F.when(kind & side, F.col("u"))).alias(f"{name}_{at}")
          for name, kind in (("live", live), ("sure", sure)) for at, side in (("firm", ~late), ("late", late))],
        F.count_if(live).alias("live"), F.count_if(live & plain).alias("plain"), F.count_if(live & heads).alias("heads"),
    )
    return found.select(
        "v", "live", "plain", "heads", F.coalesce("live_firm", "live_late").alias("u"),
        F.coalesce(F.when(F.col("live_firm").isNotNull(), F.col("live_firm") == F.col("sure_firm")).otherwise(F.col("live_late") == F.col("sure_late")), F.lit(False)).alias("yes"),
        F.coalesce("sure_firm", "sure_late").alias("stop"), F.col("sure_firm").isNull().alias("stop_late"),
    )


def _claims(judged: DataFrame, choice: DataFrame, queues: DataFrame) -> DataFrame | None:
    """Settles the groups that wait for one queue and nothing else, up to the first one there that waits for more.

    In row order each place that is new to the queue takes the queue's next row, and the groups of a place share
    it; places for which no row is left keep their first group.
    """
    only = choice.filter(ONLY_HEAD).select("v")
    if only.isEmpty():
        return None
    heads = judged.filter(HEAD).filter("verdict <> 'no'")
    waiting = heads.join(spread(only), "v", "left_semi").select("v", "q", F.col("v_place").alias("place"), "at")
    others = heads.join(spread(only), "v", "left_anti")
    sure = waiting.join(spread(others.groupBy("q").agg(F.min("v").alias("border"))), "q", "left").filter("border IS NULL OR v < border")
    places = sure.groupBy("q", "place").agg(F.min("v").alias("first"), F.min("at").alias("head"))
    turns = ranked(places, ["q"], [F.col("first").asc()], "turn").withColumn("at", F.col("head") + F.col("turn") - 1)
    given = turns.join(spread(queues), ["q", "at"], "left").select("q", "place", "first", "u")
    return checkpoint(
        sure.join(spread(given), ["q", "place"]).select(
            F.col("v").alias("s"), F.col("u").alias("to"), F.when(F.col("v") == F.col("first"), F.col("place")).alias("gave")
        )
    )


def _advanced(heads: DataFrame, placed: DataFrame, queues: DataFrame) -> DataFrame:
    """Edges at the head of a queue after a round: at the row that took their place, else at the next free one.

    An edge whose queue has ended stays as one that is ruled out, so that its group is settled.
    """
    taken = placed.select(F.col("k").alias("u"), "gave").join(spread(queues), "u")
    taken = taken.select("q", F.col("gave").alias("v_place"), F.col("u").alias("got"))
    steps = taken.groupBy("q").agg(F.count("*").cast("int").alias("steps"))
    ahead = queues.select("q", F.col("at").alias("goal"), F.col("u").alias("ahead"))
    out = heads.join(spread(taken), ["q", "v_place"], "left").join(spread(steps), "q", "left").withColumn("goal", F.col("at") + F.col("steps"))
    out = out.join(spread(ahead), ["q", "goal"], "left")
    return out.withColumns({
        "u": F.coalesce("got", "ahead", "u"), "at": F.coalesce("goal", "at"), "u_city": F.when(F.col("got").isNotNull(), F.col("v_place")),
        "u_gone": F.col("got").isNull() & F.col("goal").isNotNull() & F.col("ahead").isNull(),
    }).select(heads.columns)


def _chains(single: DataFrame, settled: DataFrame) -> DataFrame | None:
    """Settles groups that hang on one other group each, in as many steps as the longest chain has doublings.

    Such a group is kept just when the other one is not. Pointers with a sign are joined to themselves, so each
    step halves the way to a chain's end; ends that are settled settle their chains. None where no two links meet.
    """
    now = single.select("v", "u", F.col("u").alias("root"), F.lit(True).alias("flip"))

    def doubled(rows: DataFrame) -> DataFrame:
        ahead = rows.select(F.col("v").alias("at"), F.col("root").alias("next"), F.col("flip").alias("more"))
        return rows.join(spread(ahead), rows["root"] == F.col("at"), "left").select(
            "v", "u", F.coalesce("next", "root").alias("root"), (F.col("flip") != F.coalesce("more", F.lit(False))).alias("flip"),
            F.col("next").isNotNull().alias("moved"),
        )

    now = checkpoint(doubled(doubled(now)))
    if now.filter("root <> u").isEmpty():
        return None  # single steps: the next round takes them
    while not now.filter("moved").isEmpty():
        now = checkpoint(doubled(doubled(now)))
    ends = settled.select(F.col("s").alias("end"), F.col("to").isNull().alias("kept"))
    known = now.join(spread(ends), now["root"] == F.col("end"))
    return known.select(F.col("v").alias("s"), F.when(F.col("kept") == F.col("flip"), F.col("u")).alias("to"))


#: Rounds whose outcomes are brought together in one table.
FOLD = 8
#: Edges of the first groups that are settled before the others; each further batch has about as many as all before it.
BATCH = 1_000_000


def _batches(edges: DataFrame) -> list[Column]:
    """Conditions on ``v`` that deal the groups to batches in row order. Where they lie changes no outcome."""
    n, v = edges.count(), F.col("v")
    steps = max(0, (n - 1).bit_length() - (BATCH - 1).bit_length()) if n > BATCH else 0
    if not steps:
        return [F.lit(True)]
    bounds = sorted(set(edges.agg(F.percentile_approx("v", [2.0 ** (i - steps) for i in range(steps)])).first()[0]))
    return [v <= bounds[0], *[(v > a) & (v <= b) for a, b in zip(bounds, bounds[1:])], v > bounds[-1]]


def _begun(edges: DataFrame, done: list[DataFrame], taken: list[DataFrame], queues: DataFrame | None) -> DataFrame:
    """The edges of a batch as the outcomes of the batches before leave them."""
    if done:
        gone = _together(done).filter("to IS NOT NULL").select("s")
        edges = edges.join(spread(gone), edges["u"] == gone["s"], "left_anti")
    # neighbours that are open rows without any edge left of their own, or settled ones, are kept from the start
    waiting = edges.select(F.col("v").alias("w")).distinct()
    state = edges.join(spread(waiting), edges["u"] == waiting["w"], "left").withColumns(
        {"u_open": F.col("u_late") & F.col("w").isNotNull(), "u_gone": F.lit(False)}
    ).drop("w")
    return _placed(state, _together(taken), queues) if taken else state


def _placed(state: DataFrame, placed: DataFrame, queues: DataFrame | None) -> DataFrame:
    """Edges after kept rows without a place took one."""
    rest = state if queues is None else state.filter(f"NOT ({HEAD})")
    rest = rest.join(spread(placed), rest["u"] == F.col("k"), "left").withColumn("u_city", F.coalesce("u_city", "gave")).drop("k", "gave")
    return rest if queues is None else rest.unionByName(_advanced(state.filter(HEAD), placed, queues))


def resolve(edges: DataFrame, queues: DataFrame | None = None) -> DataFrame:
    """(v, u): the keeper each open group ends at, in the order-dependent sense: the first
    earlier kept row that is similar and in the same place at that moment.

    Works in rounds over all groups at once. A group is settled when the first of its
    remaining earlier neighbours that does not rule itself out is certainly a match, or none
    remains (then it is kept). A neighbour kept without a place takes the place of its first
    match, so while its place is open only the earliest waiting group may claim it. The
    earliest unsettled group always settles, so the rounds end; the first groups are settled before the rounds of later ones begin, so
    that edges which cannot be judged yet are not read in every round; chains in which each group hangs on one
    other are settled at once by pointer doubling, and a group with any certain match counts as not kept before
    its own match is known. Edges to a queue (see ``candidate_edges``) move along it; groups that wait for nothing
    else are settled together. A round's edges are
    deleted once the next round's are written; its choices are part of the result.
    """
    at_queue = [] if queues is None else ["q", "at"]
    edges = checkpoint(edges.select("v", "v_place", "u", "u_late", F.col("u_place").alias("u_city"), *at_queue))
    done, taken = [], []
    batches = _batches(edges)
    for i, batch in enumerate(batches):
        later = i < len(batches) - 1
        state = checkpoint(_begun(edges.filter(batch), done, taken, queues))
        while not state.isEmpty():
            judged = _judged(state)
            choice = checkpoint(_choices(judged))
            claims = None if queues is None else _claims(judged, choice, queues)
            # the first group at a queue is among the claims if it waits for nothing else
            certain = choice.filter("live = 0 OR yes") if claims is None else choice.filter(f"live = 0 OR (yes AND NOT ({ONLY_HEAD}))")
            settled = certain.select(F.col("v").alias("s"), F.col("u").alias("to"))
            # kept rows without a place take that of the first group they are matched with
            placed = judged.filter("verdict = 'yes' AND u_city IS NULL AND v_place IS NOT NULL").join(
                spread(settled), (F.col("v") == F.col("s")) & (F.col("u") == F.col("to"))
            ).select(F.col("u").alias("k"), F.col("v_place").alias("gave"))
            if claims is not None:
                settled = settled.unionAll(claims.select("s", "to"))
                placed = placed.unionAll(claims.filter("to IS NOT NULL AND gave IS NOT NULL").select("to", "gave"))
            if later:
                placed = checkpoint(placed)
                taken.append(placed)
            chained = _chains(choice.filter("live = 1 AND plain = 1"), settled)
            if chained is not None:
                settled = checkpoint(settled.unionAll(chained))
            done.append(settled)
            open_ = choice.filter("live > 0 AND NOT yes").select(F.col("v").alias("o"), "stop", "stop_late")
            if chained is not None or claims is not None:
                open_ = open_.join(spread(settled.select(F.col("s").alias("o"))), "o", "left_anti")
            # edges that are ruled out stay so, and behind a certain match nothing counts: both go
            left = (
                judged.filter("verdict <> 'no'").join(spread(open_), judged["v"] == F.col("o"))
                .filter("stop IS NULL OR struct(u_late, u) <= struct(stop_late, stop)").select(*state.columns)
            )
            # a group with a certain match anywhere is not kept, whichever match it ends at
            moved = settled.select(F.col("s").alias("m"), F.col("to").isNotNull().alias("goes")).unionAll(
                open_.filter("stop IS NOT NULL").select("o", F.lit(True))
            )
            left = left.join(spread(moved), left["u"] == F.col("m"), "left").withColumns(
                {"u_open": F.col("u_open") & F.col("m").isNull(), "u_gone": F.col("u_gone") | F.coalesce("goes", F.lit(False))}
            ).drop("m", "goes")
            now = checkpoint(_placed(left, placed, queues))
            discard(state)
            state = now
            if len(done) > FOLD:
                done = [checkpoint(_together(done))]
            if len(taken) > FOLD:
                taken = [checkpoint(_together(taken))]
    if not done:
        return edges.select("v", "u").limit(0)
    return _together(done).select(F.col("s").alias("v"), F.col("to").alias("u"))


def _together(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


def fuzzy_decisions(decided: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """Complete the decisions: open rows become ``keep`` or ``fuzzy`` with their keeper."""
    decided = checkpoint(decided)
    firm, opened = _nodes(decided)
    opened = checkpoint(opened)
    if opened.isEmpty():
        return decided
    ends = resolve(*candidate_edges(firm, opened, partners))
    groups = opened.join(spread(ends.withColumnRenamed("v", "node")), "node", "left").select(
        F.col("name").alias("g_name"), F.col("place").alias("g_place"), "node", F.col("u").alias("end"), "salts"
    )
    rows = decided.filter("decision = 'open'").withColumns(
        {"g_name": nz.sorted_tokens("name_key"), "g_place": nz.place_key("city"), "g_salt": _salt()}
    )
    # a group goes to those parts only that its rows are dealt to
    parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.call_function("getbit", "salts", i) == 1)
    groups = groups.withColumn("g_salt", F.explode(parts)).drop("salts")
    r, g = rows.alias("r"), spread(groups).alias("g")
    placed = r.join(
        g,
        (F.col("r.g_name") == F.col("g.g_name")) & F.col("r.g_place").eqNullSafe(F.col("g.g_place"))
        & (F.col("r.g_salt") == F.col("g.g_salt")),
    )
    keeper = F.coalesce("g.end", "g.node")
    done = placed.select(
        *[F.col(f"r.{c}") for c in decided.columns if c not in ("decision", "keeper")],
        F.when(keeper == F.col("r.seq"), "keep").otherwise("fuzzy").alias("decision"),
        keeper.alias("keeper"),
    )
    return decided.filter("decision <> 'open'").unionByName(done)


def dedupe(raw: DataFrame, companies: DataFrame | None = None, partners: int = PARTNERS) -> DataFrame:
    """The full decision log over raw rows; see merged_leads and contact_seeds for results."""
    return fuzzy_decisions(exact_decisions(candidates(raw), companies), partners)


def removal_counts(decided: DataFrame) -> DataFrame:
    return decided.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("decision") == "keep").alias("kept"),
        F.count_if(F.col("decision") != "keep").alias("removed"),
        *[F.count_if(F.col("decision") == d).alias(d) for d in ("no_identity", "existing", "exact", "fuzzy")],
    )
