"""The three batch jobs of the reference, as compositions of library operators.

* :func:`integrate`   raw keyed tables -> one wide fact (job I)
* :func:`clean_enrich` wide fact -> derived columns, resolved geography (job II)
* :func:`featurize`   clean table -> encoded features + fitted model + report (job III)

Nothing is hard-coded to one schema: every column name is a field of a config
dataclass whose defaults follow the reference's warehouse names.  Each job
builds one lazy plan; actions happen only inside encoder fits, guards, and at
the sinks.  Write the output of a job (``sources.sinks.write_parquet``) to
cut lineage between jobs.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinery import functions as RF
from refinery.features.chain import from_spec
from refinery.operators import grouping, joins, resolve, tables
from refinery.session import cut_lineage
from refinery.sources.files import load_keyed_table
from refinery.sources.sinks import write_keyed


# --------------------------------------------------------------------------- job I
@dataclass
class ListSource:
    """One list column: ``table`` grouped by ``key`` collecting ``value`` (ordered by ``order_by``)."""
    table: str
    key: str
    value: str
    alias: str
    order_by: list[str] = field(default_factory=list)


@dataclass
class IntegrateConfig:
    jobs_key: str = "ID"
    history_key: str = "JOBID"
    company_key: str = "UID"
    company_ref: str = "COMPANYUID"
    version: str = "PARSED"
    history_prefix: str = "WH_"
    company_prefix: str = "COMPANY_"
    segmentation_cols: list[str] = field(default_factory=lambda: ["JOBID", "NAME", "VALUE", "LABEL", "TYPE",
                                                                  "SORTORDER"])
    segmentation_prefix: str = "SEGMENTATION_DATA_"
    occupation_cols: dict[str, str] = field(default_factory=lambda: {"JOBID": "JOBID", "PREFLABEL": "OCCUPATION"})
    skill_link: tuple[str, str] = ("SKILLID", "ID")
    lists: list[ListSource] = field(default_factory=lambda: [
        ListSource("additional_skills", "JOBID", "PREFLABEL", "ADDITIONAL_SKILLS"),
        ListSource("job_tags", "JOBID", "TAG", "TAGS"),
        ListSource("skills", "JOBID", "PREFLABEL", "SKILLS"),
    ])
    drop_columns: list[str] = field(default_factory=list)
    dedup_mode: str = "latest_per_key"


def load_job_tables(t: dict[str, DataFrame], cfg: IntegrateConfig | None = None) -> dict[str, DataFrame]:
    """S2 and J4 of job I: ``t`` with its keyed tables loaded and ``skills`` built from links and labels."""
    cfg = cfg or IntegrateConfig()
    return t | {
        "jobs": load_keyed_table(t["jobs"], cfg.jobs_key, "string", cfg.version, cfg.dedup_mode),
        "work_history": load_keyed_table(t["work_history"], cfg.history_key, "string", cfg.version, "row_dedup"),
        "companies": load_keyed_table(t["companies"], cfg.company_key, "string", cfg.version, cfg.dedup_mode),
        "skills": joins.link_join(t["job_skill_links"], t["skill_labels"], *cfg.skill_link),
    }


def store_job_tables(t: dict[str, DataFrame], buckets: int, prefix: str, folder: str,
                     cfg: IntegrateConfig | None = None) -> dict[str, DataFrame]:
    """The loaded tables of job I, each bucketed and sorted by its key as text.

    ``integrate(stored, cfg, loaded=True)`` joins and groups them by the job key
    without moving a row; rows move once, in the write.  The tables are named
    ``prefix`` + name in the session's catalog, their files lie under ``folder``,
    which driver and executors share.
    """
    cfg = cfg or IntegrateConfig()
    loaded = load_job_tables(t, cfg)
    keys = {"jobs": cfg.jobs_key, "work_history": cfg.history_key, "companies": cfg.company_key,
            "segmentation": cfg.segmentation_cols[0], "occupations": next(iter(cfg.occupation_cols)),
            **{ls.table: ls.key for ls in cfg.lists}}
    return {name: write_keyed(loaded[name].withColumn(key, F.col(f"`{key}`").cast("string")), prefix + name, key, buckets,
                              f"{folder.rstrip('/')}/{name}") for name, key in keys.items()}


def integrate(t: dict[str, DataFrame], cfg: IntegrateConfig | None = None, loaded: bool = False) -> DataFrame:
    """Job I: keyed loads, fact joins, guarded lookups, list aggregation, strict drop.

    ``t`` holds ``jobs``, ``work_history``, ``companies``, ``segmentation``,
    ``occupations``, ``job_skill_links``, ``skill_labels`` and the tables named
    by ``cfg.lists`` (``skills`` is built from the link and label tables), or,
    with ``loaded``, what :func:`load_job_tables` or :func:`store_job_tables` made of them.
    """
    cfg = cfg or IntegrateConfig()
    sources = t if loaded else load_job_tables(t, cfg)
    jobs, hist, comp = sources["jobs"], sources["work_history"], sources["companies"]

    # Join order: every join keyed by the job id first, so the wide fact is
    # hash-partitioned on it once and the later job-keyed joins reuse that
    # partitioning; the company join (another key) comes last.  The output
    # column order is restored at the end.
    # Job x work history (inner), history columns prefixed, its key dropped.
    fact = joins.join_prefixed(jobs, hist, cfg.jobs_key, cfg.history_key, cfg.history_prefix)
    c = tables.prefix_columns(comp, cfg.company_prefix)
    # One-row-per-job lookups (fan-out is an error).
    seg = tables.prefix_columns(tables.strict_select(sources["segmentation"], cfg.segmentation_cols),
                                cfg.segmentation_prefix)
    fact = joins.guarded_lookup(fact, seg, cfg.jobs_key, cfg.segmentation_prefix + cfg.segmentation_cols[0])
    occ = tables.rename(tables.strict_select(sources["occupations"], list(cfg.occupation_cols)), cfg.occupation_cols)
    occ_key = cfg.occupation_cols[next(iter(cfg.occupation_cols))]
    fact = joins.guarded_lookup(fact, occ.withColumnRenamed(occ_key, "__occ_key"), cfg.jobs_key, "__occ_key")
    # D1 + J5: ordered lists per job, [] when a job has none.
    for ls in cfg.lists:
        src = sources[ls.table]
        g = grouping.ordered_list(src, ls.key, ls.value, ls.order_by or [ls.value], alias=ls.alias)
        fact = joins.join_grouped(fact, g.withColumnRenamed(ls.key, "__lk"), cfg.jobs_key, "__lk", [ls.alias])
    # Companies on the string-cast company reference.
    before = fact.columns
    fact = joins.join_on_string_key(fact, c, cfg.company_ref, cfg.company_prefix + cfg.company_key)
    hist_cols = [x for x in before if x.startswith(cfg.history_prefix)]
    head = [x for x in before if x in jobs.columns or x in hist_cols]
    tail = [x for x in before if x not in head]
    fact = fact.select(*[F.col(f"`{x}`") for x in head + c.columns + tail])
    return tables.strict_drop(fact, cfg.drop_columns) if cfg.drop_columns else fact


# -------------------------------------------------------------------------- job II
@dataclass
class EnrichConfig:
    reference_date: dt.date = dt.date(2024, 12, 1)
    posted: str = "COMPANY_JOBSPOSTEDCOUNT"
    filled: str = "COMPANY_JOBSFILLEDCOUNT"
    hire_rate: str = "COMPANY_HIRE_RATE"
    contract_date: str = "COMPANY_CONTRACTDATE"
    experience: str = "COMPANY_EXPERIENCE"
    start: str = "WH_STARTDATE"
    end: str = "WH_ENDDATE"
    duration: str = "WH_DURATION"
    duration_label_src: str = "OPENINGDURATION"
    duration_label: str = "ENGAGEMENTDURATIONLABEL"
    job_type: str = "JOBTYPE"
    fixed_value: str = "FIXED"
    engagement_src: str = "HOURLYENGAGEMENTTYPE"
    engagement: str = "ENGAGEMENTTYPE"
    engagement_fixed_label: str = "PROJECT"
    fixed_amount: str = "FIXEDPRICEAMOUNT"
    budget_min_src: str = "HOURLYBUDGETMIN"
    budget_max_src: str = "HOURLYBUDGETMAX"
    country: str = "COMPANY_COUNTRY"
    city: str = "COMPANY_CITY"
    state: str = "COMPANY_STATE"
    country_overrides: dict[str, str] = field(default_factory=dict)
    city_overrides: dict[str, str] = field(default_factory=dict)
    fuzzy_threshold: float = 0.80
    accept_threshold: float = 0.88
    require_state: bool = False  # true: a row without a state never gets an agglomeration
    flags: list[str] = field(default_factory=list)
    target: str | None = "WH_TOTALCHARGE"
    remove_columns: list[str] = field(default_factory=list)
    rename: dict[str, str] = field(default_factory=dict)


def derive_columns(df: DataFrame, cfg: EnrichConfig) -> DataFrame:
    """The derived columns of job II (one projection)."""
    is_fixed = F.coalesce(F.col(cfg.job_type) == F.lit(cfg.fixed_value), F.lit(False))
    return df.withColumns({
        cfg.hire_rate: RF.safe_ratio(cfg.filled, cfg.posted),
        cfg.duration: RF.hours_between(RF.parse_timestamp_strict(cfg.start), RF.parse_timestamp_strict(cfg.end)),
        cfg.experience: RF.calendar_months_since(RF.parse_timestamp_coerce(cfg.contract_date), cfg.reference_date),
        cfg.duration_label: F.col(cfg.duration_label_src),
        cfg.engagement: F.when(is_fixed, F.lit(cfg.engagement_fixed_label)).otherwise(F.col(cfg.engagement_src)),
        "BUDGET_MIN": F.when(is_fixed, F.col(cfg.fixed_amount)).otherwise(F.col(cfg.budget_min_src)),
        "BUDGET_MAX": F.when(is_fixed, F.col(cfg.fixed_amount)).otherwise(F.col(cfg.budget_max_src)),
    })


def clean_enrich(df: DataFrame, countries: DataFrame, city_alias_dim: DataFrame, gdp: DataFrame | None = None,
                 city_resolutions: DataFrame | None = None, agglomerations: DataFrame | None = None,
                 cfg: EnrichConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Job II: derived columns, country/city resolution and enrichment, final hygiene.

    ``countries``: ``name, iso2, iso3, population``; ``city_alias_dim`` from
    :func:`resolve.build_alias_dimension`; ``gdp``: ``code, gdppc``;
    ``city_resolutions``: ``old_name, country, new_name``; ``agglomerations``:
    ``city, state, country, agglomeration``.  Returns ``(clean, city_mapping)``.
    """
    cfg = cfg or EnrichConfig()
    df = derive_columns(df, cfg)
    # Country: overrides, precedence lookup on distinct values, drop unresolved.
    df = tables.require_not_null(df, cfg.country)
    df = tables.replace_values(df, cfg.country, cfg.country_overrides)
    # Resolved once per distinct value; materialised because it is counted
    # (broadcast check) and joined.
    iso = cut_lineage(resolve.precedence_lookup(df, cfg.country, countries, "name", "iso2", "iso3",
                                                out_col="__iso3"))
    df = df.join(joins.checked_broadcast(iso), cfg.country, "left")
    df = df.withColumn(cfg.country, F.col("__iso3")).drop("__iso3")
    df = tables.require_not_null(df, cfg.country)
    # a code listed twice has its largest population, as a city has
    pop = countries.groupBy(F.col("iso3").alias(cfg.country)).agg(F.max("population").alias("COUNTRY_POPULATION"))
    df = joins.guarded_lookup(df, pop, cfg.country)
    if gdp is not None:
        g = gdp.select(F.col("code").alias(cfg.country), F.col("gdppc").alias("COUNTRY_GDPPC"))
        df = joins.guarded_lookup(df, g, cfg.country)
    # City: overrides, fuzzy match on distinct (city, country), accept split, fallback table.
    df = tables.replace_values(df, cfg.city, cfg.city_overrides)
    pairs = tables.drop_incomplete(df.select(cfg.city, cfg.country), [cfg.city, cfg.country]).distinct()
    best = resolve.fuzzy_best_match(pairs, cfg.city, cfg.country, city_alias_dim, threshold=cfg.fuzzy_threshold)
    acc, rest = resolve.confidence_split(best, cfg.accept_threshold)
    if city_resolutions is not None:
        rest = resolve.fallback_resolve(rest, [cfg.city, cfg.country], city_resolutions, ["old_name", "country"],
                                        answer_col="new_name", out_col="match")
    else:
        rest = rest.withColumn("match", F.lit(None).cast("string"))
    # The mapping is joined back and also returned (the reference saves it).
    mapping = cut_lineage(resolve.accepted_union(acc, rest, [cfg.city, cfg.country, "match"]))
    city_map = mapping.select(F.col(cfg.city).alias("old_name"), F.col(cfg.country).alias("country"),
                              F.col("match").alias("new_name"))
    df = df.join(joins.checked_broadcast(mapping.withColumnRenamed("match", "__city")), [cfg.city, cfg.country], "left")
    df = df.withColumn(cfg.city, F.col("__city")).drop("__city")
    df = tables.require_not_null(df, cfg.city)
    # City population (R7: join on the normalised name, same-name cities -> max population).
    cpop = (city_alias_dim.groupBy(F.col("block").alias(cfg.country), F.col("canonical").alias(cfg.city))
            .agg(F.max("population").alias("CITY_POPULATION")))
    df = joins.guarded_lookup(df, cpop, [cfg.country, cfg.city], check=False)
    if agglomerations is not None:
        trip = df.select(cfg.city, cfg.state, cfg.country).distinct()
        res = agglomerations.select(F.col("city").alias("c"), F.col("state").alias("s"), F.col("country").alias("k"),
                                    "agglomeration")
        agg = resolve.fallback_resolve(trip, [cfg.city, cfg.state, cfg.country], res, ["c", "s", "k"],
                                       answer_col="agglomeration", out_col="CITY_AGGLOMERATION",
                                       null_safe=[] if cfg.require_state else [cfg.state])
        cond = [df[cfg.city] == agg[cfg.city], df[cfg.state].eqNullSafe(agg[cfg.state]),
                df[cfg.country] == agg[cfg.country]]
        df = df.join(agg, cond, "left").drop(agg[cfg.city]).drop(agg[cfg.state]).drop(agg[cfg.country])
    # Flags, target filter, lenient drop, rename-and-order.
    df = df.withColumns({c: RF.to_flag(c) for c in cfg.flags})
    if cfg.target:
        df = tables.require_not_null(df, cfg.target)
    df = tables.lenient_drop(df, cfg.remove_columns)
    if cfg.rename:
        df = tables.rename_and_keep(df, cfg.rename)
    return df, city_map


# ------------------------------------------------------------------------- job III
def featurize(df: DataFrame, spec):
    """Job III: fit the declarative encoder chain; returns ``(model, features)``.

    Persist with ``features.chain.save_model`` / ``save_report`` and
    ``sources.sinks.write_parquet``.
    """
    return from_spec(spec).fit_transform(df)
