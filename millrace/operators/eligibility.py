"""Which of many tasks may run on which of many machines.

Every gate turns a task's payload into *needs* and a machine's description into
*offers*, both sets of short strings. A task may run where its needs are a
subset of the offers and it does not exclude the machine. Tasks with equal
needs, and machines with equal offers, are collapsed into classes first; classes
are matched by equality on each need's rarest string and then checked in full,
so the pairs of tasks and machines are never spelled out.

Payload and capabilities are VARIANT because the types of untrusted fields
matter: ``true``, ``1`` and ``"1"`` are three different things. A malformed need
is one nobody offers; a malformed offer is no offer.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written

GATES = ["argv", "module", "data", "gpus", "exclude", "pool", "isolation"]

TEXTS = "array<string>"
ITEMS = "array<variant>"


# -- reading VARIANT ----------------------------------------------------------


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, "$." + path, "variant")


def _kind(v: Column) -> Column:
    """Type name; ``VOID`` for an absent field as for JSON null."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is_true(v: Column) -> Column:
    return (_kind(v) == "BOOLEAN") & F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(False))


def _is_false(v: Column) -> Column:
    return (_kind(v) == "BOOLEAN") & ~F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(True))


def _is_list(v: Column) -> Column:
    return _kind(v).startswith("ARRAY")


def _is_object(v: Column) -> Column:
    return _kind(v).startswith("OBJECT")


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", ITEMS), F.array().cast(ITEMS))


def _text(v: Column) -> Column:
    """The value of a string field, NULL for any other type."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _all_texts(v: Column) -> Column:
    return _is_list(v) & F.forall(_items(v), lambda x: _kind(x) == "STRING")


def _none() -> Column:
    return F.array().cast(TEXTS)


def _one(value: Column | str) -> Column:
    return F.array(F.lit(value) if isinstance(value, str) else value).cast(TEXTS)


def _tagged(prefix: str, v: Column) -> Column:
    return F.transform(_items(v), lambda x: F.concat(F.lit(prefix), F.to_json(x)))


# -- needs of a task ----------------------------------------------------------

#: Payload fields the gates read.
FIELDS = ["argv", "module", "local_inputs", "gpus", "exclude_nodes", "pool", "isolation"]


class Payload:
    """A task's payload by field: read from a VARIANT, or from columns that
    :func:`read_fields` has already taken out of it."""

    def __init__(self, source: Column | None = None):
        self.source = source

    def __getitem__(self, name: str) -> Column:
        return F.col("_f_" + name) if self.source is None else _get(self.source, name)

    def kind(self, name: str) -> Column:
        return F.col("_k_" + name) if self.source is None else _kind(self[name])


def read_fields(tasks: DataFrame) -> DataFrame:
    """Take every field and its type out of ``payload`` once per row."""
    taken = tasks.withColumns({"_f_" + n: _get(F.col("payload"), n) for n in FIELDS})
    return taken.withColumns({"_k_" + n: _kind(F.col("_f_" + n)) for n in FIELDS})


def _waived(payload: Payload) -> Column:
    isolation = payload["isolation"]
    return payload.kind("isolation").startswith("OBJECT") & _is_true(_get(isolation, "allowFallback"))


def _need_argv(payload: Payload) -> Column:
    pool = F.when(payload.kind("pool") == "STRING", F.try_variant_get(payload["pool"], "$", "string"))
    trusted = F.coalesce(pool != "", F.lit(False)) & _waived(payload)
    return F.when(
        payload["argv"].isNotNull(),
        _one(F.when(trusted, "argv:any").otherwise("argv:contained")),
    ).otherwise(_none())


def _need_module(payload: Payload) -> Column:
    return F.when(payload["module"].isNotNull(), _one("module")).otherwise(_none())


def _need_data(payload: Payload) -> Column:
    v, kind = payload["local_inputs"], payload.kind("local_inputs")
    return (
        F.when(kind == "VOID", _none())
        .when(~kind.startswith("ARRAY"), _one("never:data"))
        .otherwise(_tagged("data:", v))
    )


def _need_gpus(payload: Payload) -> Column:
    v, kind = payload["gpus"], payload.kind("gpus")
    n = F.try_variant_get(v, "$", "bigint")
    whole = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") & F.coalesce(n >= 0, F.lit(False))
    return (
        F.when(kind == "VOID", _none())
        .when(~whole, _one("never:gpus"))
        .when(n == 0, _none())
        .otherwise(_one(F.concat(F.lit("gpus:"), n)))
    )


def _need_exclude(payload: Payload) -> Column:
    v, kind = payload["exclude_nodes"], payload.kind("exclude_nodes")
    return (
        F.when(kind == "VOID", _none())
        .when(~_all_texts(v), _one("never:exclude"))
        .when(F.size(_items(v)) == 0, _none())
        .otherwise(_one("identified"))
    )


def _need_pool(payload: Payload) -> Column:
    v, kind = payload["pool"], payload.kind("pool")
    name = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    return (
        F.when(kind == "VOID", _none())
        .when(F.coalesce(name != "", F.lit(False)), _one(F.concat(F.lit("pool:"), name)))
        .otherwise(_one("never:pool"))
    )


def _need_isolation(payload: Payload) -> Column:
    v, kind = payload["isolation"], payload.kind("isolation")
    tier = _get(v, "tier")
    ordinary = (_kind(tier) == "VOID") | F.coalesce(_text(tier).isin("", "standard"), F.lit(False))
    return (
        F.when(kind == "VOID", _none())
        .when(~kind.startswith("OBJECT"), _one("never:isolation"))
        .when(ordinary | _waived(payload), _none())
        .otherwise(_one("sandbox"))
    )


NEEDS = {
    "argv": _need_argv,
    "module": _need_module,
    "data": _need_data,
    "gpus": _need_gpus,
    "exclude": _need_exclude,
    "pool": _need_pool,
    "isolation": _need_isolation,
}


def needs(payload: Column | Payload) -> Column:
    """Everything a task asks for, as a sorted set."""
    payload = payload if isinstance(payload, Payload) else Payload(payload)
    return F.array_sort(F.array_distinct(F.concat(*[NEEDS[g](payload) for g in GATES])))


def excluded_nodes(payload: Column | Payload) -> Column:
    payload = payload if isinstance(payload, Payload) else Payload(payload)
    v = payload["exclude_nodes"]
    return F.when(
        payload.kind("exclude_nodes").startswith("ARRAY") & _all_texts(v),
        F.array_sort(F.array_distinct(F.coalesce(F.try_variant_get(v, "$", TEXTS), _none()))),
    ).otherwise(_none())


# -- offers of a machine ------------------------------------------------------


def offers(node: dict[str, Column] | None = None) -> Column:
    """Everything a machine can satisfy, as a sorted set. ``node`` maps field names
    to Columns; by default they are columns of the same name."""
    c = (lambda n: node[n]) if node else F.col
    capabilities = c("capabilities")
    gpus = _get(capabilities, "gpus")
    pools = _get(capabilities, "pools")
    count = F.when(_is_object(capabilities) & _is_list(gpus), F.size(_items(gpus))).otherwise(0)
    when = lambda cond, text: F.when(cond, _one(text)).otherwise(_none())
    argv, open_argv = _is_true(c("argv_capable")), _is_true(c("unsandboxed_argv_capable"))
    parts = [
        when(argv, "argv:contained"),
        when(argv | open_argv, "argv:any"),
        when(~_is_false(c("module_capable")), "module"),
        F.when(_is_list(c("local_datasets")), _tagged("data:", c("local_datasets"))).otherwise(_none()),
        F.when(
            count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit("gpus:"), i))
        ).otherwise(_none()),
        when(F.coalesce(c("node_id") != "", F.lit(False)), "identified"),
        F.when(
            _is_object(capabilities) & _all_texts(pools),
            F.transform(
                F.coalesce(F.try_variant_get(pools, "$", TEXTS), _none()),
                lambda p: F.concat(F.lit("pool:"), p),
            ),
        ).otherwise(_none()),
        when(_is_true(c("sandbox_capable")), "sandbox"),
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


# -- one pair -----------------------------------------------------------------


def gate(name: str, payload: Column, node: dict[str, Column] | None = None) -> Column:
    """One gate's verdict on a row that already holds a task and a machine."""
    met = F.size(F.array_except(NEEDS[name](Payload(payload)), offers(node))) == 0
    if name == "exclude":
        node_id = node["node_id"] if node else F.col("node_id")
        met = met & ~F.coalesce(F.array_contains(excluded_nodes(payload), node_id), F.lit(False))
    return met


def eligible(payload: Column, node: dict[str, Column] | None = None) -> Column:
    node_id = node["node_id"] if node else F.col("node_id")
    subset = F.size(F.array_except(needs(payload), offers(node))) == 0
    return subset & ~F.coalesce(F.array_contains(excluded_nodes(payload), node_id), F.lit(False))


def has_all(required: Column, advertised: Column) -> Column:
    """Every required name is advertised; nothing advertised satisfies nothing."""
    return F.coalesce(F.size(F.array_except(required, advertised)) == 0, F.size(required) == 0)


# -- tables -------------------------------------------------------------------


def task_needs(tasks: DataFrame) -> DataFrame:
    """``job_id, task_id, seq, need, excluded`` of each task."""
    return read_fields(tasks).select(
        "job_id",
        "task_id",
        "seq",
        needs(Payload()).alias("need"),
        excluded_nodes(Payload()).alias("excluded"),
    )


def node_offers(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", offers().alias("offer"))


def class_matches(needed: DataFrame, offered: DataFrame) -> DataFrame:
    """Pairs of need class and offer class that fit, with the machines of each.

    A class of needs is looked up by the need that fewest offer classes satisfy.
    """
    wanted = needed.select("need").distinct()
    supply = offered.groupBy("offer").agg(F.count(F.lit(1)).alias("nodes"))
    listed = supply.select(
        "offer", "nodes", F.explode(F.concat("offer", _one(""))).alias("token")
    )
    scarcity = listed.groupBy("token").agg(F.count(F.lit(1)).alias("_freq"))
    asked = wanted.select(
        "need",
        F.explode(F.when(F.size("need") > 0, F.col("need")).otherwise(_one(""))).alias("token"),
    )
    rarest = (
        asked.join(scarcity, "token", "left")
        .groupBy("need")
        .agg(F.min(F.struct(F.coalesce("_freq", F.lit(0)), "token")).alias("_r"))
        .select("need", "_r.token")
    )
    return (
        rarest.join(listed, "token")
        .filter(F.size(F.array_except("need", "offer")) == 0)
        .select("need", "offer", "nodes")
    )


def eligible_counts(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many machines may run each task: ``job_id, task_id, eligible_nodes``."""
    needed, offered = task_needs(tasks), node_offers(nodes)
    matches = class_matches(needed, offered)
    fits = matches.groupBy("need").agg(F.sum("nodes").alias("_fit"))
    barred = (
        needed.filter(F.size("excluded") > 0)
        .select("job_id", "task_id", "need", F.explode("excluded").alias("node_id"))
        .join(offered, "node_id")
        .join(matches.select("need", "offer"), ["need", "offer"])
        .groupBy("job_id", "task_id")
        .agg(F.count(F.lit(1)).alias("_barred"))
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    return (
        needed.select("job_id", "task_id", "need")
        .join(fits, "need", "left")
        .join(barred, ["job_id", "task_id"], "left")
        .select("job_id", "task_id", (n("_fit") - n("_barred")).cast("bigint").alias("eligible_nodes"))
    )


def unplaceable_tasks(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    return eligible_counts(tasks, nodes).filter("eligible_nodes = 0").drop("eligible_nodes")


def reject_reasons(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each need of each task, how many machines do not satisfy it."""
    offered = node_offers(nodes)
    satisfied = (
        offered.select(F.explode("offer").alias("need")).groupBy("need").agg(F.count(F.lit(1)).alias("_n"))
    )
    total = offered.agg(F.count(F.lit(1)).alias("_total")).withColumn("_one", F.lit(1))
    asked = task_needs(tasks).select("job_id", "task_id", F.explode("need").alias("need"))
    per_need = asked.select("need").distinct().join(satisfied, "need", "left")
    lacking = (
        per_need.withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .select("need", (F.col("_total") - F.coalesce("_n", F.lit(0))).alias("nodes_lacking"))
        .filter("nodes_lacking > 0")
    )
    return asked.join(lacking, "need").select("job_id", "task_id", "need", "nodes_lacking")


def _skipped(picky: DataFrame, offered: DataFrame, matches: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """Tasks that exclude machines, the first of each kind by rank (``need, _place, _t``), and
    for machines that the very first exclude how many in a row do (``node_id, offer, need, _skip``).

    Only the first ``first`` of a kind are looked at, a bound that Spark applies before it
    shuffles; machines that all of them exclude look eight times as far, until none is left.
    """
    order = Window.partitionBy("need").orderBy("_t")
    run = F.aggregate(
        F.array_sort(F.collect_set("_place")), F.lit(0), lambda n, p: F.when(p == n + 1, p).otherwise(n)
    )
    settled, open_ = [], None
    while True:
        tops = picky.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= first)
        tops = written(tops, "placement-first")
        named = tops.select("need", "_place", F.explode("excluded").alias("node_id")).join(offered, "node_id")
        named = named.join(matches, ["need", "offer"], "left_semi")
        if open_ is not None:
            named = named.join(open_, ["node_id", "need"], "left_semi")
        runs = named.groupBy("node_id", "offer", "need").agg(run.alias("_skip")).filter("_skip > 0")
        runs = written(runs, "placement-skips")
        settled.append(runs.filter(F.col("_skip") < first))
        open_ = runs.filter(F.col("_skip") == first).select("node_id", "need")
        if open_.isEmpty():
            return tops.select("need", "_place", "_t"), reduce(DataFrame.unionByName, settled)
        first *= 8


def first_choice(tasks: DataFrame, nodes: DataFrame, score: str | None = None, first: int = 64) -> DataFrame:
    """The task each machine would take next: highest ``score`` (a whole-number column
    of ``tasks``), then earliest in the queue. Machines with nothing to do are absent.

    Tasks with equal needs are a kind, and only the first of a kind competes. A machine
    that the first task excludes takes the next of the kind that does not name it; all
    other machines of a class have the same answer.
    """
    rank = -F.col(score) if score else F.lit(0).cast("bigint")
    needed = read_fields(tasks).select(
        F.struct(rank.alias("_rank"), "seq", "job_id", "task_id").alias("_t"),
        needs(Payload()).alias("need"),
        excluded_nodes(Payload()).alias("excluded"),
    )
    needed = written(needed, "placement-needs")
    offered = written(node_offers(nodes), "placement-offers")
    matches = written(class_matches(needed, offered).select("need", "offer"), "placement-matches")
    plain = needed.filter(F.size("excluded") == 0).groupBy("need").agg(F.min("_t").alias("_plain"))
    picky = needed.filter(F.size("excluded") > 0)
    tops, skips = _skipped(picky, offered, matches, first)

    heads = plain.join(tops.filter("_place = 1").select("need", F.col("_t").alias("_head")), "need", "full")
    heads = written(heads, "placement-heads")
    best = F.least("_plain", "_head")
    by_class = matches.join(heads, "need").groupBy("offer").agg(F.min(best).alias("_t"))
    # Machines that a first task names look at each kind themselves.
    apart = skips.select("node_id", "offer").distinct()
    next_ = skips.withColumn("_place", F.col("_skip") + 1).join(tops, ["need", "_place"], "left")
    next_ = next_.select("node_id", "need", F.col("_t").alias("_next"), F.lit(True).alias("_named"))
    own = apart.join(matches, "offer").join(heads, "need").join(next_, ["node_id", "need"], "left")
    best = F.when(F.col("_named"), F.least("_plain", "_next")).otherwise(best)
    by_node = own.groupBy("node_id").agg(F.min(best).alias("_t"))
    rest = offered.join(apart.select("node_id"), "node_id", "left_anti").join(by_class, "offer").select("node_id", "_t")
    chosen = rest.unionByName(by_node).filter(F.col("_t").isNotNull())
    return chosen.select("node_id", "_t.job_id", "_t.task_id", "_t.seq")


# -- capacity offers ----------------------------------------------------------


#: What a request may ask for at least, and an offer have.
DEMANDS = ["gpus", "vram_gb", "cpus", "memory_gb"]
#: Offers of a key that are pruned together, at first.
OFFER_PART = 10_000


def _undominated(rows: pd.DataFrame) -> pd.DataFrame:
    """Offers, by price and name, that no earlier one matches or beats in every demand."""
    rows = rows.sort_values(["hourly_usd", "offer_id"], na_position="first", kind="stable")
    x = rows[DEMANDS].to_numpy("float64")
    kept: list[int] = []
    for k in range(len(x)):
        if not (kept and (x[kept] >= x[k]).all(axis=1).any()):
            kept.append(k)
    return rows.iloc[kept]


def skyline(listed: DataFrame, keys: list[str], part: int = OFFER_PART) -> DataFrame:
    """Of offers with equal ``keys`` those that are worth a look: every other one has a
    cheaper that is as good in each demand. Equal offers are one, and parts of a key are
    pruned first, so that what meets in one task is their undominated offers. Offers
    without a price are a kind apart."""
    own = [*keys, "_free"]
    kinds = listed.withColumn("_free", F.col("hourly_usd").isNull())
    kinds = kinds.groupBy(*own, *DEMANDS).agg(F.min(F.struct("hourly_usd", "offer_id")).alias("_o"))
    kinds = written(kinds.select(*own, *DEMANDS, "_o.hourly_usd", "_o.offer_id"), "offer-kinds")
    parts = kinds.groupBy(*own).agg(F.ceil(F.count(F.lit(1)) / part).alias("_parts"))
    prune = lambda pdf: _undominated(pdf)
    large = kinds.join(parts.filter("_parts > 1"), own).withColumn("_part", F.pmod(F.xxhash64("offer_id"), "_parts")).drop("_parts")
    some = large.groupBy(*own, "_part").applyInPandas(prune, large.schema).drop("_part")
    small = kinds.join(parts.filter("_parts = 1").select(*own), own).select(*kinds.columns)
    return small.unionByName(some).groupBy(*own).applyInPandas(prune, small.schema).drop("_free")


def match_offers(requests: DataFrame, offers_: DataFrame) -> DataFrame:
    """Cheapest acceptable offer per request; requests nothing fits are absent.

    ``requests``: ``request_id, gpus, gpu_type, vram_gb, cpus, memory_gb, region,
    max_hourly_usd, spot_ok`` (NULL asks for nothing); ``offers_``: ``offer_id, gpus,
    gpu_type, vram_gb, cpus, memory_gb, region, hourly_usd, spot``. An offer that
    does not state a figure cannot meet a demand for it.

    Equal requests are answered once. Offers enter under every (type, region, spot) key
    they can serve, and of a key only the :func:`skyline` is compared: an offer that a
    cheaper one matches in every demand is never the answer.
    """
    keys = ["k_type", "k_region", "k_spot"]
    nothing = F.lit(float("-inf"))
    asked = requests.select(
        "request_id",
        F.coalesce(F.lower("gpu_type"), F.lit("*")).alias("k_type"),
        F.coalesce("region", F.lit("*")).alias("k_region"),
        F.coalesce("spot_ok", F.lit(True)).alias("k_spot"),
        F.greatest(F.coalesce(F.col("gpus").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("gpus"),
        *[F.coalesce(F.col(c).cast("double"), nothing).alias(c) for c in DEMANDS[1:]],
        F.coalesce(F.col("max_hourly_usd").cast("double"), F.lit(float("inf"))).alias("most"),
    )
    asked = written(asked, "offer-requests")
    rest = [*DEMANDS, "most"]
    profiles = asked.select(*keys, *rest).distinct()
    types = F.explode(F.array_compact(F.array(F.lit("*"), F.lower("gpu_type"))))
    regions = F.explode(F.array_compact(F.array(F.lit("*"), F.col("region"))))
    spots = F.explode(F.when(F.col("spot"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False))))
    listed = offers_.select(
        "offer_id", F.col("hourly_usd").cast("double").alias("hourly_usd"), "gpu_type", "region", "spot",
        F.coalesce(F.col("gpus").cast("double"), F.lit(0.0)).alias("gpus"),
        *[F.coalesce(F.col(c).cast("double"), nothing).alias(c) for c in DEMANDS[1:]],
    ).withColumn("k_type", types).withColumn("k_region", regions).withColumn("k_spot", spots)
    index = written(skyline(listed.select(*keys, *DEMANDS, "hourly_usd", "offer_id"), keys), "offer-skyline")
    index = index.select(*keys, *[F.col(c).alias("o_" + c) for c in DEMANDS], F.struct("hourly_usd", "offer_id").alias("_o"))
    meets = F.coalesce(F.col("_o.hourly_usd") <= F.col("most"), F.col("most") == float("inf"))
    for c in DEMANDS:
        meets = meets & (F.col("o_" + c) >= F.col(c))
    best = profiles.join(index, keys).filter(meets).groupBy(*keys, *rest).agg(F.min("_o").alias("_o"))
    return asked.join(best, [*keys, *rest]).select("request_id", "_o.offer_id", "_o.hourly_usd")
