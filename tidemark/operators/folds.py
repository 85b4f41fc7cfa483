"""Event-to-state folds in closed form.

Every table is a keyed aggregation (partial before the exchange, final after), so a
subject with a third of all events costs one buffer per map task and no task ever
holds its history. `ord` is the arrival order; A is the arrival of the first usable
`link.added` of a subject and only events after A count.

"Last value after A" needs no A in the aggregation: the last value overall is either
after A, or there is none after A. Counts do need A, so the two counted event kinds
are joined, as three narrow columns, with one row per subject; a hot subject is salted.

Dialects: "imperative" (default; replayable) and "sql" (the upsert statement set).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.payload import (
    has_key,
    json_fragment,
    json_tags,
    meta_json,
    present,
    unwrap_payload,
    valid_visibility,
)
from tidemark.functions.urls import normalize_url
from tidemark.operators.skew import hot_keys, skew_join
from tidemark.sources.ledger import with_payload

LINK_TYPES = (
    "link.added",
    "content.fetched",
    "enrichment.completed",
    "publish.completed",
    "link.visibility_changed",
)


def is_type(kind: str) -> Column:
    return F.col("event_type") == kind


def _last(value: Column, when: Column) -> Column:
    return F.max_by(F.struct(F.col("ord"), value.alias("v")), F.when(when, F.col("ord")))


def _first(value: Column, when: Column) -> Column:
    return F.min_by(F.struct(F.col("ord"), value.alias("v")), F.when(when, F.col("ord")))


def fetch_error() -> Column:
    return is_type("content.fetched") & present("p.fetch_error")


def decoded(events: DataFrame, types: tuple[str, ...]) -> DataFrame:
    # The NULL check is stated here, not left to the joins that would infer it, so that
    # two uses of one aggregate keep the same plan and share its exchange.
    wanted = events.filter(F.col("event_type").isin(*types) & F.col("subject_id").isNotNull())
    return with_payload(wanted)


# ---------------------------------------------------------------- links


def link_partials(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One mergeable row per link subject (imperative dialect).

    `known` is an earlier result of this function; its subjects keep their A.
    Subjects without any usable `link.added` yield no row.
    """
    ev = decoded(events, LINK_TYPES)
    added_ok = is_type("link.added") & present("p.url")
    fetched, enriched, published = (
        is_type("content.fetched"),
        is_type("enrichment.completed"),
        is_type("publish.completed"),
    )
    failed = fetch_error()
    ok = fetched & ~present("p.fetch_error")

    def content(name: str) -> Column:
        return _last(F.col(f"p.{name}"), fetched & F.col(f"p.{name}").isNotNull()).alias(f"c_{name}")

    def metadata(name: str, value: Column) -> Column:
        return _last(value, enriched & value.isNotNull()).alias(f"m_{name}")

    wide = ev.groupBy("subject_id").agg(
        _first(F.struct("p.url", "p.url_norm", F.col("occurred_at").alias("created_at"), "source"), added_ok).alias("added"),
        _last(F.col("p.visibility"), is_type("link.visibility_changed") & valid_visibility("p.visibility")).alias("vis"),
        _last(F.when(published, "published").otherwise("error"), failed | published).alias("terminal"),
        _last(F.struct("occurred_at", F.col("p.fetch_error").alias("error")), failed).alias("err"),
        F.max(F.when(ok, F.col("ord"))).alias("ok_ord"),
        F.max(F.when(enriched, F.col("ord"))).alias("enrich_ord"),
        _last(F.col("occurred_at"), published).alias("pub"),
        content("final_url"),
        content("title"),
        content("text_content"),
        content("html_storage_key"),
        _last(F.struct("occurred_at", F.col("p.fetch_error").alias("fetch_error")), fetched).alias("c_last"),
        _last(F.col("p.tags"), enriched & (F.size("p.tags") > 0)).alias("m_tags"),
        metadata("summary_short", F.coalesce("p.summary_short", "p.summary")),
        metadata("summary_long", F.col("p.summary_long")),
        metadata("language", F.col("p.language")),
        metadata("model_version", F.col("p.model_version")),
        _last(F.col("occurred_at"), enriched).alias("m_last"),
    )
    anchors = ev.filter(added_ok | published | enriched | failed).groupBy("subject_id").agg(
        F.min(F.when(is_type("link.added"), F.col("ord"))).alias("a_ord"),
        F.max(F.when(published, F.col("ord"))).alias("p_ord"),
        F.count_if(enriched | failed).alias("n_rows"),
    )
    if known is not None:
        before = known.select("subject_id", F.col("added").alias("_known"))
        wide = wide.join(before, "subject_id", "left").withColumn("added", F.coalesce("_known", "added")).drop("_known")
        anchors = (
            anchors.join(before.select("subject_id", F.col("_known.ord").alias("_k")), "subject_id", "full_outer")
            .withColumn("a_ord", F.coalesce("_k", "a_ord"))
            .drop("_k")
        )
    counts = _counts(ev, anchors, enriched, failed)
    a = F.col("added.ord")
    plain = ["ok_ord", "enrich_ord"]
    late = [c for c in wide.columns if c not in ("subject_id", "added", *plain)]
    return (
        wide.filter(F.col("added").isNotNull())
        .select(
            "subject_id",
            "added",
            *[F.when(F.col(c) > a, F.col(c)).alias(c) for c in plain],
            *[F.when(F.col(c)["ord"] > a, F.col(c)).alias(c) for c in late],
        )
        .join(counts, "subject_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_err", "n_enrich", "n_before_pub")})
    )


def _counts(ev: DataFrame, anchors: DataFrame, enriched: Column, failed: Column) -> DataFrame:
    """Fetch errors and enrichments after A, and enrichments before the last publish.

    `anchors` has subject_id, a_ord, p_ord and n_rows, the number of rows to count.
    Subjects above their share of the rows (a list that hot_keys bounds) meet their rows
    through a broadcast of their anchors; those rows then take no part in the match on
    subject and are only spread by a salt. Both uses of `anchors` need the same columns,
    so Spark computes it once and reuses the exchange.
    """
    rows = ev.filter(enriched | failed).select("subject_id", "ord", enriched.alias("is_enrich"))
    base = anchors.filter(F.col("a_ord").isNotNull() & (F.col("n_rows") > 0))
    hot = F.broadcast(
        hot_keys(base, ["subject_id", "a_ord", "p_ord"], "n_rows").select(
            "subject_id", F.col("a_ord").alias("hot_a"), F.col("p_ord").alias("hot_p"), "_salts"
        )
    )
    is_hot = F.col("hot_a").isNotNull()
    cold = base.select(F.col("subject_id").alias("_key"), F.lit(0).alias("_salt"), "a_ord", "p_ord")
    return (
        rows.join(hot, "subject_id", "left")
        .withColumn("_key", F.when(~is_hot, F.col("subject_id")))
        .withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64("ord"), "_salts").cast("int")).otherwise(0))
        .join(cold, ["_key", "_salt"], "left")
        .withColumn("_a", F.coalesce("hot_a", "a_ord"))
        .withColumn("_p", F.when(is_hot, F.col("hot_p")).otherwise(F.col("p_ord")))
        .filter(F.col("ord") > F.col("_a"))
        .groupBy("subject_id")
        .agg(
            F.count_if(~F.col("is_enrich")).alias("n_err"),
            F.count_if("is_enrich").alias("n_enrich"),
            F.count_if(F.col("is_enrich") & (F.col("ord") < F.col("_p"))).alias("n_before_pub"),
        )
    )


def _link_columns() -> list[Column]:
    url = F.col("added.v.url")
    status = (
        F.when(F.col("terminal").isNotNull(), F.col("terminal.v"))
        .when(F.col("enrich_ord").isNotNull(), "enriched")
        .when(F.col("ok_ord").isNotNull(), "fetched")
        .otherwise("new")
    )
    return [
        url.alias("url"),
        F.coalesce("added.v.url_norm", normalize_url("added.v.url")).alias("url_norm"),
        F.col("added.v.created_at").alias("created_at"),
        F.col("added.v.source").alias("source"),
        status.alias("status"),
        F.coalesce("vis.v", F.lit("public")).alias("visibility"),
        F.lit(False).alias("pinned"),
        F.col("n_err").cast("int").alias("retry_count"),
        F.col("err.v.occurred_at").alias("last_error_at"),
        F.col("err.v.error").alias("last_error"),
    ]


def links(partials: DataFrame) -> DataFrame:
    return partials.select("subject_id", *_link_columns(), F.col("added.ord").alias("added_ord"))


# Which subjects have a row in the other link tables.
_HAS_CONTENT = "c_last IS NOT NULL"
_HAS_METADATA = "m_last IS NOT NULL"
_HAS_PUBLISH = "n_enrich > 0"


def link_rows(partials: DataFrame) -> DataFrame:
    """All link tables as one row per subject, straight from the fold: the columns that
    joining links, content, metadata and publish state by subject would give, NULL where
    the subject has no row in a table."""

    def within(condition: str, columns: list[Column], names: list[str]) -> list[Column]:
        return [F.when(F.expr(condition), c).alias(n) for c, n in zip(columns, names)]

    return partials.select(
        "subject_id",
        *_link_columns(),
        *within(_HAS_CONTENT, _content_columns(), CONTENT_NAMES),
        *within(_HAS_METADATA, _metadata_columns(), METADATA_NAMES),
        *within(_HAS_PUBLISH, _publish_columns(), PUBLISH_NAMES),
    )


def unique_url(link_rows: DataFrame) -> DataFrame:
    """Of several subjects with one `url_norm`, the first to arrive keeps the link row."""
    others = [c for c in link_rows.columns if c not in ("url_norm", "added_ord")]
    return (
        link_rows.groupBy("url_norm")
        .agg(F.min_by(F.struct(*others, "added_ord"), "added_ord").alias("r"))
        .select("url_norm", "r.*")
        .select(*link_rows.columns)
    )


CONTENT_NAMES = ["final_url", "title", "text_content", "html_storage_key", "fetched_at", "fetch_error"]
METADATA_NAMES = ["tags", "summary_short", "summary_long", "language", "model_version", "updated_at"]
PUBLISH_NAMES = ["desired_version", "published_version", "dirty", "last_published_at"]


def _content_columns() -> list[Column]:
    last = F.col("c_last.v")
    return [F.col(f"c_{c}.v").alias(c) for c in CONTENT_NAMES[:4]] + [last["occurred_at"].alias("fetched_at"), last["fetch_error"].alias("fetch_error")]


def link_content(partials: DataFrame) -> DataFrame:
    return partials.filter(_HAS_CONTENT).select("subject_id", *_content_columns())


def _metadata_columns() -> list[Column]:
    tags = F.coalesce("m_tags.v", F.array().cast("array<string>")).alias("tags")
    return [tags] + [F.col(f"m_{c}.v").alias(c) for c in METADATA_NAMES[1:5]] + [F.col("m_last.v").alias("updated_at")]


def link_metadata(partials: DataFrame) -> DataFrame:
    return partials.filter(_HAS_METADATA).select("subject_id", *_metadata_columns())


def _publish_columns() -> list[Column]:
    done = F.col("n_before_pub") > 0
    return [
        F.col("n_enrich").cast("int").alias("desired_version"),
        F.when(done, F.col("n_before_pub")).otherwise(0).cast("int").alias("published_version"),
        (~done | (F.col("enrich_ord") > F.col("pub.ord"))).alias("dirty"),
        F.when(done, F.col("pub.v")).alias("last_published_at"),
    ]


def publish_state(partials: DataFrame) -> DataFrame:
    return partials.filter(_HAS_PUBLISH).select("subject_id", *_publish_columns())


def merge_partials(
    old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("subject_id",), first: tuple[str, ...] = ("added",)
) -> DataFrame:
    """Combine the partials of an earlier prefix of the stream with those of a later batch.

    Columns in `first` keep the older value, counts add up, and every other column
    takes the newer value where there is one, because later batches hold later
    positions.
    """
    o, n = old.alias("o"), new.alias("n")
    zero = F.lit(0).cast("bigint")

    def num(side: str, name: str) -> Column:
        return F.coalesce(F.col(f"{side}.{name}"), zero)

    columns: list[Column] = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    for name in (c for c in old.columns if c not in keys):
        if name in first:
            merged = F.coalesce(f"o.{name}", f"n.{name}")
        elif name == "n_before_pub":
            merged = F.when(F.col("n.pub").isNotNull(), num("o", "n_enrich") + num("n", name)).otherwise(num("o", name))
        elif name.startswith("n_"):
            merged = num("o", name) + num("n", name)
        else:
            merged = F.coalesce(f"n.{name}", f"o.{name}")
        columns.append(merged.alias(name))
    return o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer").select(*columns)


# ------------------------------------------------- links, "sql" dialect


def links_sql(events: DataFrame) -> DataFrame:
    """Statement-set semantics: a repeated add resets the row, every stage sets the status."""
    ev = decoded(events, LINK_TYPES)
    added, fetched, enriched, published = (is_type(t) for t in LINK_TYPES[:4])
    added = added & F.col("p.url").isNotNull()
    failed = fetched & F.col("p.fetch_error").isNotNull()
    changed = is_type("link.visibility_changed") & valid_visibility("p.visibility")
    stage = (
        F.when(added, "new").when(failed, "error").when(fetched, "fetched").when(enriched, "enriched").otherwise("published")
    )
    base = ev.groupBy("subject_id").agg(
        F.min(F.when(added, F.col("ord"))).alias("first_ord"),
        _last(F.struct("p.url", "p.url_norm", "occurred_at", "source"), added).alias("added"),
        _last(stage, added | fetched | enriched | published).alias("stage"),
        _last(F.when(added, F.lit("public")).otherwise(F.col("p.visibility")), added | changed).alias("vis"),
        _last(F.struct("occurred_at", F.col("p.fetch_error").alias("error")), failed).alias("err"),
    )
    anchors = (
        ev.filter(added | failed)
        .groupBy("subject_id")
        .agg(F.max(F.when(added, F.col("ord"))).alias("a_ord"), F.count_if(failed).alias("n_rows"))
        .withColumn("p_ord", F.lit(None).cast(ev.schema["ord"].dataType))
    )
    counts = _counts(ev, anchors, F.lit(False), failed).select("subject_id", "n_err")
    recent = F.col("err.ord") > F.col("added.ord")
    return (
        base.filter(F.col("added").isNotNull())
        .join(counts, "subject_id", "left")
        .select(
            "subject_id",
            F.col("added.v.url").alias("url"),
            F.coalesce("added.v.url_norm", "added.v.url").alias("url_norm"),
            F.col("added.v.occurred_at").alias("created_at"),
            F.col("added.v.source").alias("source"),
            F.col("stage.v").alias("status"),
            F.col("vis.v").alias("visibility"),
            F.lit(False).alias("pinned"),
            F.coalesce("n_err", F.lit(0)).cast("int").alias("retry_count"),
            F.when(recent, F.col("err.v.occurred_at")).alias("last_error_at"),
            F.when(recent, F.col("err.v.error")).alias("last_error"),
        )
    )


def link_content_sql(events: DataFrame) -> DataFrame:
    """The last fetch replaces the whole row."""
    ev = decoded(events, ("link.added", "content.fetched"))
    names = ("final_url", "title", "text_content", "html_storage_key", "fetch_error")
    return (
        ev.groupBy("subject_id")
        .agg(
            F.min(F.when(is_type("link.added") & F.col("p.url").isNotNull(), F.col("ord"))).alias("a_ord"),
            _last(F.struct(*[f"p.{c}" for c in names], "occurred_at"), is_type("content.fetched")).alias("c"),
        )
        .filter(F.col("c.ord") > F.col("a_ord"))
        .select(
            "subject_id",
            *[F.col(f"c.v.{c}").alias(c) for c in names[:4]],
            F.col("c.v.occurred_at").alias("fetched_at"),
            F.col("c.v.fetch_error").alias("fetch_error"),
        )
    )


def link_metadata_sql(events: DataFrame) -> DataFrame:
    """Tags: '[]' keeps the old array, a missing field clears it; text fields coalesce."""
    ev = decoded(events, ("link.added", "enrichment.completed")).withColumn(
        "t", json_tags(json_fragment(unwrap_payload("payload"), "$.tags"))
    )
    enriched = is_type("enrichment.completed")
    fields = {
        "summary_short": F.coalesce("p.summary_short", "p.summary"),
        "summary_long": F.col("p.summary_long"),
        "language": F.col("p.language"),
        "model_version": F.col("p.model_version"),
    }
    agg = ev.groupBy("subject_id").agg(
        F.min(F.when(is_type("link.added") & F.col("p.url").isNotNull(), F.col("ord"))).alias("a_ord"),
        _last(F.col("occurred_at"), enriched).alias("at"),
        _last(F.col("t"), enriched & F.col("t").isNotNull()).alias("tags"),
        *[_last(v, enriched & v.isNotNull()).alias(n) for n, v in fields.items()],
    )
    a = F.col("a_ord")
    return agg.filter(F.col("at.ord") > a).select(
        "subject_id",
        F.coalesce(F.when(F.col("tags.ord") > a, F.col("tags.v")), F.array().cast("array<string>")).alias("tags"),
        *[F.when(F.col(n)["ord"] > a, F.col(n)["v"]).alias(n) for n in fields],
        F.col("at.v").alias("updated_at"),
    )


def publish_state_sql(events: DataFrame) -> DataFrame:
    """Constant versions: enrichment writes 1/0/dirty, publish writes 1/clean."""
    ev = events.filter(F.col("event_type").isin("enrichment.completed", "publish.completed"))
    agg = ev.groupBy("subject_id").agg(
        F.max(F.when(is_type("enrichment.completed"), F.col("ord"))).alias("e"),
        _last(F.col("occurred_at"), is_type("publish.completed")).alias("p"),
    )
    clean = F.col("p").isNotNull() & (F.col("e").isNull() | (F.col("p.ord") > F.col("e")))
    return agg.select(
        "subject_id",
        F.when(F.col("e").isNotNull(), 1).otherwise(0).alias("desired_version"),
        F.when(clean, 1).otherwise(0).alias("published_version"),
        (~clean).alias("dirty"),
        F.when(clean, F.col("p.v")).alias("last_published_at"),
    )


# ------------------------------------------------------------- subjects


def subject_partials(events: DataFrame) -> DataFrame:
    """Per (subject, subject_id): the creating event and the last todo title."""
    ev = decoded(events, ("link.added", "temp.reading_recorded", "todo.created", "annotation.added"))
    usable = (
        (is_type("link.added") & present("p.url"))
        | (is_type("temp.reading_recorded") & has_key(unwrap_payload("payload"), "celsius"))
        | (is_type("todo.created") & present("p.title"))
        | is_type("annotation.added")
    )
    # Subject names and metadata per event type.
    kind = (
        F.when(is_type("link.added"), "link")
        .when(is_type("temp.reading_recorded"), "sensor")
        .when(is_type("todo.created"), "todo")
        .otherwise("annotation")
    )
    start = F.struct(
        F.col("occurred_at").alias("created_at"),
        F.when(is_type("link.added"), F.lit("public"))
        .when(is_type("annotation.added"), F.coalesce("p.visibility", F.lit("private")))
        .otherwise("private")
        .alias("visibility"),
        F.when(is_type("temp.reading_recorded"), F.lit('{"type":"temperature"}'))
        .when(is_type("todo.created"), meta_json("source"))
        .otherwise("{}")
        .alias("meta"),
    )
    return (
        ev.filter(usable)
        .withColumn("subject", kind)
        .groupBy("subject", "subject_id")
        .agg(
            _first(start, F.lit(True)).alias("s"),
            _last(F.col("p.title"), is_type("todo.created")).alias("title"),
        )
    )


def visibility_partials(events: DataFrame) -> DataFrame:
    """Per subject_id: the last valid visibility change."""
    ev = decoded(events, ("link.visibility_changed",)).filter(valid_visibility("p.visibility"))
    return ev.groupBy("subject_id").agg(_last(F.col("p.visibility"), F.lit(True)).alias("vis"))


def subjects_from(base: DataFrame, changes: DataFrame) -> DataFrame:
    return base.join(changes, "subject_id", "left").select(
        "subject",
        "subject_id",
        F.col("s.v.created_at").alias("created_at"),
        F.col("title.v").alias("display_name"),
        F.coalesce(F.when(F.col("vis.ord") > F.col("s.ord"), F.col("vis.v")), F.col("s.v.visibility")).alias("visibility"),
        F.col("s.v.meta").alias("meta"),
    )


def subjects(events: DataFrame) -> DataFrame:
    """First event fixes the row, a todo's title follows, visibility by subject id alone."""
    return subjects_from(subject_partials(events), visibility_partials(events))


# -------------------------------------------------------------- sensors


def reading_partials(events: DataFrame, dialect: str = "imperative") -> DataFrame:
    ev = decoded(events, ("temp.reading_recorded",)).filter(F.col("p.celsius").isNotNull())
    value = F.struct("p.celsius", "p.humidity", "p.battery")
    pick = F.min_by if dialect == "imperative" else F.max_by
    return ev.groupBy("subject_id", "occurred_at").agg(pick(value, F.col("ord")).alias("v"))


def temperature_readings(events: DataFrame, dialect: str = "imperative") -> DataFrame:
    """One row per (subject, time): the first arrival wins, in the sql dialect the last."""
    return reading_partials(events, dialect).select("subject_id", "occurred_at", "v.celsius", "v.humidity", "v.battery")


def temperature_latest(events: DataFrame, dialect: str = "imperative") -> DataFrame:
    """Greatest event time (ties: the earlier arrival); in the sql dialect the last arrival."""
    if dialect == "sql":
        ev = decoded(events, ("temp.reading_recorded",)).filter(F.col("p.celsius").isNotNull())
        value = F.struct("occurred_at", "p.celsius", "p.humidity", "p.battery")
        return ev.groupBy("subject_id").agg(F.max_by(value, F.col("ord")).alias("v")).select("subject_id", "v.*")
    return latest_of(temperature_readings(events))


def latest_of(readings: DataFrame) -> DataFrame:
    value = F.struct("occurred_at", "celsius", "humidity", "battery")
    return readings.groupBy("subject_id").agg(F.max_by(value, "occurred_at").alias("v")).select("subject_id", "v.*")


# ---------------------------------------------------- todos, annotations


def todo_partials(events: DataFrame) -> DataFrame:
    ev = decoded(events, ("todo.created", "todo.completed"))
    created = is_type("todo.created") & present("p.title")
    return ev.groupBy("subject_id").agg(
        _first(meta_json("source"), created).alias("first"),
        _last(F.struct("p.title", F.coalesce("p.labels", F.array().cast("array<string>")).alias("labels"), "occurred_at"), created).alias("last"),
        _last(F.col("p.project"), created & F.col("p.project").isNotNull()).alias("project"),
        _last(F.col("p.due_at"), created & F.col("p.due_at").isNotNull()).alias("due"),
        _last(F.col("occurred_at"), is_type("todo.completed")).alias("done"),
    )


def todos(events: DataFrame) -> DataFrame:
    return todos_from(todo_partials(events))


def todos_from(partials: DataFrame) -> DataFrame:
    done = F.coalesce(F.col("done.ord") > F.col("first.ord"), F.lit(False))
    return partials.filter(F.col("first").isNotNull()).select(
        "subject_id",
        F.col("last.v.title").alias("title"),
        F.col("project.v").alias("project"),
        F.col("last.v.labels").alias("labels"),
        F.when(done, "done").otherwise("open").alias("status"),
        F.try_to_timestamp("due.v").alias("due_at"),
        F.when(done, F.col("done.v")).alias("completed_at"),
        F.col("first.v").alias("meta"),
    )


def link_arrivals(events: DataFrame) -> DataFrame:
    """(link_subject_id, parent_ord): when each link came to exist."""
    ev = decoded(events, ("link.added",)).filter(present("p.url"))
    return ev.groupBy(F.col("subject_id").alias("link_subject_id")).agg(F.min("ord").alias("parent_ord"))


def annotation_partials(events: DataFrame, parents: DataFrame) -> DataFrame:
    ev = decoded(events, ("annotation.added",))
    notes = ev.filter(is_type("annotation.added") & F.col("p.annotation_id").isNotNull()).select(
        "ord",
        "occurred_at",
        "subject_id",
        "p.annotation_id",
        "p.link_subject_id",
        "p.quote",
        "p.note",
        F.coalesce("p.selector", F.lit("{}")).alias("selector"),
        F.coalesce("p.visibility", F.lit("private")).alias("visibility"),
    )
    return (
        skew_join(notes, parents, ["link_subject_id"], "left", salt_by="ord")
        .groupBy("annotation_id")
        .agg(
            _first(
                F.struct("subject_id", "link_subject_id", F.col("occurred_at").alias("created_at"), "visibility"),
                F.col("ord") > F.col("parent_ord"),
            ).alias("first"),
            _last(F.struct("selector", "occurred_at"), F.lit(True)).alias("last"),
            _last(F.col("quote"), F.col("quote").isNotNull()).alias("q"),
            _last(F.col("note"), F.col("note").isNotNull()).alias("n"),
        )
    )


def annotations(events: DataFrame) -> DataFrame:
    """Keyed by annotation id; the first event whose parent link exists creates the row."""
    return annotations_from(annotation_partials(events, link_arrivals(events)))


def annotations_from(partials: DataFrame) -> DataFrame:
    made = F.col("first.ord")
    return partials.filter(F.col("first").isNotNull()).select(
        "annotation_id",
        "first.v.subject_id",
        "first.v.link_subject_id",
        "first.v.created_at",
        F.when(F.col("last.ord") > made, F.col("last.v.occurred_at")).alias("updated_at"),
        F.when(F.col("q.ord") >= made, F.col("q.v")).alias("quote"),
        F.when(F.col("n.ord") >= made, F.col("n.v")).alias("note"),
        F.col("last.v.selector").alias("selector"),
        F.col("first.v.visibility").alias("visibility"),
    )
