"""Survey tables derived from a star schema.

The benchmark tables hold orders, parts, documents, conversations and events.
Responses, enrichments, survey answers and exports are derived from them row
by row with integer arithmetic, so they grow with the tables and any engine
computes the same values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import cleaning, scores

# Fixed values of the derivation -------------------------------------------

# Remarks that follow the document text of a comment.
REMARKS = (
    "Te duur voor wat het is, de prijs mag omlaag.",
    "Bezorging is vaak te laat.",
    "Klantenservice gaf goede hulp.",
    "De app crasht, inloggen lukt niet online.",
    "Veel nieuws en goede artikelen van hoge kwaliteit.",
    "Leuk blad, zeer tevreden.",
    "Ik beveel het iedereen aan.",
    "Mooie puzzels in het weekend.",
    "Betrouwbaar en objectief, veel vertrouwen.",
    "Geen mening.",
    "Het abonnement opzeggen is moeilijk, website werkt niet.",
    "Informatief en actueel uit de regio.",
    "Storing en technisch probleem met de interface.",
    "Reputatie is modern en innovatief.",
    "Kosten in euro zijn niet duidelijk.",
    "Snelheid van levering is prima.",
)

# Raw theme name for each word of a part name.
PART_THEMES = {
    "anvil": "Prijs", "blue": "app ervaring", "bolt": "levering",
    "cold": "traag", "gear": " Helpdesk ", "gizmo": "design",
    "hot": "kwaliteit", "large": "abonnement", "new": "innovatie",
    "old": "xyz", "plate": "journalistiek", "red": "delivery",
    "ring": "vertrouwen", "rod": "overige", "small": "Te Duur",
    "widget": "content",
}

# Raw themes of survey answers, before cleaning.
ANSWER_THEMES = (
    "product_quality", "question_2_customer_service", "response_text_UX",
    "pricing", "delivery_issues", "Product_Quality", "team",
)

# Channel by event type.
CHANNELS = {
    "click": "in_app", "view": "in_app", "purchase": "email",
    "signup": "web", "error": "sms",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def _after_midnight(stamp: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(stamp.cast("timestamp")) + seconds)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt by key, before text is joined to or made from them.

    A small table arrives as one file, and a shuffle of narrow rows is
    coalesced to a few partitions; both would keep the text work that follows
    on a few cores. ``key`` must be evenly distributed. The number of
    partitions is the session's; being named, it is not changed at run time.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def remark(key: Column, shift: Column) -> Column:
    return _pick(REMARKS, (key * 13 + shift) % len(REMARKS))


def responses(spark: SparkSession, sf_dir: str, *, comments: bool = False) -> DataFrame:
    """One response per order; ``comments`` adds the text columns.

    A comment is a whole document followed by a remark. Some responses have no
    comment, some only a 'not applicable' mark.
    """
    base = _responses(spark, sf_dir)
    if not comments:
        return base.drop("cust")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = spread(base.withColumn("doc_id", F.col("id") % _size(docs)), "doc_id")
    return (
        keyed.join(docs, "doc_id", "left")
        .withColumn("nps_explanation", _explanation(F.col("id"), F.col("cust")))
        .drop("doc_id", "text", "cust")
    )


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    score = ((key * 7 + cust * 3) % 11).cast("int")
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            key.alias("id"),
            cust.alias("cust"),
            F.col("o_orderpriority").alias("survey_name"),
            score.alias("nps_score"),
            F.when(key % 29 != 0, F.col("c_mktsegment")).alias("gender"),
            F.concat(F.lit("band_"), (key % 5).cast("string")).alias("age_range"),
            F.col("o_orderstatus").alias("years_employed"),
            F.col("o_orderdate").cast("date").alias("creation_date"),
            F.when(key % 37 != 0, F.col("n_name")).alias("title_text"),
            scores.category(score).alias("nps_category"),
            _after_midnight(F.col("o_orderdate"), key % 86400).alias("created_at"),
        )
    )


def _size(docs: DataFrame) -> Column:
    return docs.agg(F.count(F.lit(1))).scalar()


def _explanation(key: Column, cust: Column) -> Column:
    text = F.concat(F.col("text"), F.lit(" "), remark(key, cust))
    return F.when(key % 5 == 0, F.lit(None)).when(key % 31 == 0, " n.v.t. ").otherwise(text)


def referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The responses with ``comment_ref`` in place of the comment, null where there is none.

    Whole documents are many times wider than the rest of a row. What needs no
    text (joins by response, ranks) works on these rows; ``with_comments`` then
    puts the text of those that are left in place of the reference.
    """
    docs = table(spark, sf_dir, "documents")
    known = docs.filter(F.col("text").isNotNull()).select("doc_id").distinct().withColumn("known", F.lit(True))
    rows = _responses(spark, sf_dir).withColumn("doc_id", F.col("id") % _size(docs)).join(known, "doc_id", "left")
    none = (F.col("id") % 5 == 0) | ((F.col("id") % 31 != 0) & F.col("known").isNull())
    return rows.withColumn("comment_ref", F.when(~none, F.struct("doc_id", "cust"))).drop("doc_id", "known", "cust")


def with_comments(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows made from ``referenced`` with ``nps_explanation`` in place of ``comment_ref``."""
    key = F.col("id" if "id" in rows.columns else "response_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Rows without a comment are dealt evenly, too.
    keyed = spread(rows.withColumn("doc_id", F.coalesce("comment_ref.doc_id", -key - 1)), "doc_id")
    explanation = F.when(F.col("comment_ref").isNotNull(), _explanation(key, F.col("comment_ref.cust")))
    return (
        keyed.join(docs, "doc_id", "left")
        .withColumn("nps_explanation", explanation)
        .drop("doc_id", "text", "comment_ref")
    )


def _place(words: list[str], word: Column) -> Column:
    """Position of a word in the list."""
    return F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (w, i)])[word]


def _named(bits: str, names: Sequence[str], places: Sequence[int]) -> Column:
    """The names whose bit is set, in the order given.

    SQL text: a column object per name would take longer than planning the rest.
    """
    cases = [f"if(getbit({bits}, {p}) = 1, '{n}', null)" for n, p in zip(names, places)]
    return F.expr(f"array_compact(array({', '.join(cases)}))")


def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One enrichment per order that has line items.

    The themes and brands of an order are bits of two numbers, so that the
    aggregation over its items keeps no sets.

    Themes are the names of the ordered parts; a few orders add a niche theme
    of their own, and some have no themes at all.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    word = F.element_at(F.split("p_name", " "), F.col("l_linenumber") % 2 + 1)
    words = sorted(PART_THEMES, key=PART_THEMES.get)
    brands = sorted(range(63), key=str)
    brand = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    # The aggregation, the work on themes and a join by response all use this
    # one partitioning.
    per_order = (
        spread(items.join(parts, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey")
        .groupBy(F.col("l_orderkey").alias("response_id"))
        .agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _place(words, word))).alias("name_bits"),
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), brand)).alias("brand_bits"),
        )
        .select(
            "response_id",
            _named("name_bits", [PART_THEMES[w] for w in words], range(len(words))).alias("names"),
            _named("brand_bits", [f"brand#{n}" for n in brands], brands).alias("keywords"),
        )
    )
    key = F.col("response_id")
    niche = F.when(
        key % 499 == 0,
        F.array(F.concat(F.lit("niche_"), F.floor(key / 998).cast("string"))),
    ).otherwise(F.array().cast("array<string>"))
    themes = F.when(key % 101 != 0, F.concat("names", niche))
    mood = F.when(
        key % 13 != 0, ((key % 201 - 100).cast("decimal(5,0)") / 100).cast("decimal(3,2)")
    )
    return per_order.select(
        "response_id",
        themes.alias("themes"),
        F.try_element_at(themes, F.lit(1)).alias("primary_theme"),
        mood.alias("sentiment_score"),
        scores.sentiment_label(mood).alias("sentiment_label"),
        "keywords",
        ((key % 100) / 100.0).alias("confidence"),
        F.when(key % 17 == 0, "failed").otherwise("completed").alias("processing_status"),
        F.lit("taxonomy").alias("model"),
        remark(key, F.lit(5)).alias("summary"),
        F.timestamp_seconds(F.lit(1_000_000_000) + key).alias("created_at"),
    )


def enrichment_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment rows with reruns: several per order, some without a parent.

    One row per line item; ``row_id`` is unique. Every tenth line refers to a
    response that does not exist.
    """
    items = table(spark, sf_dir, "lineitem")
    row_id = F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    return items.select(
        F.when(F.col("l_partkey") % 10 == 0, -F.col("l_orderkey") - 1)
        .otherwise(F.col("l_orderkey"))
        .alias("response_id"),
        row_id.alias("row_id"),
        F.col("l_quantity").cast("int").alias("version"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form survey answers: one per conversation turn, whole text."""
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    pick = conv * 3 + turn
    n_themes = (pick % 4).cast("int")
    themes = F.transform(
        F.slice(F.array(F.lit(0), F.lit(1), F.lit(3)), F.lit(1), n_themes),
        lambda i: _pick(ANSWER_THEMES, (conv + turn * 2 + i) % len(ANSWER_THEMES)),
    )
    label = (
        F.when(pick % 5 < 2, "positive").when(pick % 5 < 4, "negative").otherwise("neutral")
    )
    analysis = F.when(
        pick % 11 != 0,
        F.struct(
            label.alias("sentiment"),
            (((conv * 7 + turn * 3) % 11) / 10.0).alias("sentiment_score"),
            themes.alias("themes"),
        ),
    )
    return c.select(
        F.concat(F.lit("survey_"), (conv % 5).cast("string")).alias("survey_id"),
        (conv + 2).alias("row_number"),
        F.concat(F.lit("question_"), (turn + 1).cast("string"), F.lit("_feedback")).alias("question_text"),
        turn.cast("int").alias("question_order"),
        F.col("text").alias("response_text"),
        analysis.alias("ai_analysis"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey headers: one per conversation, in any state of processing."""
    per_conv = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    key = F.col("conv_id")
    return per_conv.select(
        F.concat(F.lit("survey_"), key.cast("string")).alias("id"),
        F.concat(F.lit("Survey "), key.cast("string")).alias("name"),
        F.col("n").alias("total_responses"),
        F.when(key % 3 == 0, "processing").when(key % 3 == 1, "completed").otherwise("failed").alias("status"),
        F.timestamp_seconds(F.lit(1_700_000_000) + key * 60).alias("created_at"),
        F.timestamp_seconds(F.lit(1_700_000_000) + key * 61).alias("updated_at"),
    )


def conversation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers keyed to the headers of ``analyses``: one survey per conversation."""
    return answers(spark, sf_dir).withColumn(
        "survey_id", F.concat(F.lit("survey_"), (F.col("row_number") - 2).cast("string"))
    )


def question_count(spark: SparkSession, sf_dir: str) -> int:
    """Columns a wide upload needs: one per turn of the longest conversation."""
    return (table(spark, sf_dir, "conversations").agg(F.max("turn")).first()[0] or 0) + 1


def wide_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide upload rows: one respondent per conversation, one column per turn."""
    c = table(spark, sf_dir, "conversations")
    turns = range(question_count(spark, sf_dir))
    columns = [
        F.coalesce(F.max(F.when(F.col("turn") == t, F.col("text"))), F.lit("")).alias(
            f"question_{t + 1}_feedback"
        )
        for t in turns
    ]
    return c.groupBy("conv_id").agg(
        *columns, F.max("role").alias("segment"), F.count(F.lit(1)).cast("string").alias("size")
    ).select(
        F.concat(F.lit("survey_"), (F.col("conv_id") % 2).cast("string")).alias("survey_id"),
        F.col("conv_id").alias("file_order"),
        F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("participant_id"),
        # Answers of a few respondents are too short to keep.
        *[
            F.when(F.col("conv_id") % 7 == 3, F.lit(" kort "))
            .otherwise(F.col(f"question_{t + 1}_feedback"))
            .alias(f"question_{t + 1}_feedback")
            for t in turns
        ],
        F.when(F.col("conv_id") % 3 != 0, F.col("segment")).otherwise("").alias("segment"),
        "size",
    )


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw export rows, all text: mixed date layouts, bad scores, missing values."""
    rows = responses(spark, sf_dir)
    key, day = F.col("id"), F.col("creation_date")
    layouts = ("dd/MM/yyyy", "yyyy-MM-dd", "d-M-yyyy", "d.M.yyyy", "d/M/yyyy H:mm:ss", "dd/MM/yy")
    date_text = F.when(key % 41 == 0, "").when(key % 43 == 0, "31/31/2000")
    for i, layout in enumerate(layouts):
        date_text = date_text.when(key % len(layouts) == i, F.date_format(day, layout))
    score_text = (
        F.when(key % 19 == 0, "abc")
        .when(key % 23 == 0, "11")
        .when(key % 3 == 0, F.concat(F.col("nps_score").cast("string"), F.lit(".9")))
        .otherwise(F.concat(F.lit(" "), F.col("nps_score").cast("string")))
    )
    return rows.select(
        key.alias("row_number"),
        F.when(key % 47 != 0, F.concat(F.col("survey_name"), F.lit(" "))).otherwise("").alias("survey"),
        score_text.alias(" nps "),
        F.when(key % 6 == 0, " N.V.T. ")
        .when(key % 6 == 1, "nvt")
        .otherwise(F.concat(F.lit("  "), remark(key, F.lit(0)), F.lit("\n")))
        .alias("Nps_Toelichting"),
        F.coalesce("gender", F.lit("")).alias("GESLACHT"),
        F.col("age_range").alias("LEEFTIJD"),
        date_text.alias("CREATIE_DT"),
        F.when(key % 8 != 0, F.col("title_text")).otherwise("").alias("TITEL_TEKST"),
        F.concat(F.lit("alt_"), (key % 4).cast("string")).alias("TITEL"),
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events: user, channel, duration and comment, one month of 2024."""
    e = table(spark, sf_dir, "events")
    key = F.col("event_id")
    return e.select(
        key.alias("id"),
        F.col("user_id"),
        _lookup(CHANNELS, F.col("event_type")).alias("survey_name"),
        F.col("event_type"),
        ((key * 7 + F.col("user_id")) % 11).cast("int").alias("nps_score"),
        F.when(key % 3 != 0, F.concat(F.lit("value "), F.col("props"))).alias("nps_explanation"),
        F.col("value"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("ts").cast("date").alias("creation_date"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("response_id"), "embedding", "label"
    )


def theme_listing(assignments: DataFrame) -> DataFrame:
    """Rows (theme, count_responses, avg_nps, avg_sentiment) that hierarchies take."""
    from ..operators.themes import aggregate

    return aggregate(assignments).select(
        "theme", "count_responses", "avg_nps", "avg_sentiment"
    )


def string_stamp(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def joined(col: str | Column, mark: str = "|") -> Column:
    return F.array_join(col, mark)


def tidy_comment(col: str) -> Column:
    return cleaning.comment(F.col(col))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification answers as text: plain JSON, JSON in prose, and none at all."""
    e = enrichment(spark, sf_dir)
    key = F.col("response_id")
    confidence = key % 100 / 100.0
    proposal = F.when(
        key % 10 == 0, F.concat(F.lit("Nieuw  Thema "), (key % 20).cast("string"))
    ).when(key % 10 == 1, "")
    fields = [
        F.coalesce("primary_theme", F.lit("")).alias("primary_theme"),
        F.coalesce("themes", F.array().cast("array<string>")).alias("themes"),
        F.col("sentiment_label").alias("sentiment"),
        proposal.alias("new_theme"),
    ]
    full = F.to_json(F.struct(*fields, confidence.alias("confidence")))
    text = (
        F.when(key % 7 == 0, "geen idee")
        .when(key % 7 == 1, F.concat(F.lit("Antwoord: "), full, F.lit(" einde")))
        .when(key % 7 == 2, F.to_json(F.struct(*fields)))
        .when(
            key % 7 == 3,
            F.to_json(F.struct(*fields, confidence.cast("string").alias("confidence"))),
        )
        .otherwise(full)
    )
    return e.select("response_id", text.alias("answer"))


# Theme dimension that answers are reconciled with.
KNOWN_THEMES = ("content_kwaliteit", "pricing", "merkvertrouwen", "overige", "te-duur", "Prijs")


def theme_dimension(spark: SparkSession) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in KNOWN_THEMES], "name string")
    return names.withColumn("slug", cleaning.slug(F.col("name")))


def theme_list_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theme lists as text: JSON, JSON in prose, quoted words per line, fenced JSON."""
    e = enrichment(spark, sf_dir)
    key = F.col("response_id")
    names = F.coalesce("themes", F.array().cast("array<string>"))
    as_json = F.to_json(
        F.transform(
            names,
            lambda n: F.struct(n.alias("name"), (key % 30 / 10.0).alias("confidence")),
        )
    )
    lines = F.array_join(
        F.transform(
            names,
            lambda n: F.concat(
                F.lit('- "'), F.regexp_replace(F.lower(F.trim(n)), " ", "_"), F.lit('" "x"')
            ),
        ),
        "\n",
    )
    text = (
        F.when(key % 4 == 0, as_json)
        .when(key % 4 == 1, F.concat(F.lit("Hier: "), as_json, F.lit(" klaar")))
        .when(key % 4 == 2, lines)
        .otherwise(F.concat(F.lit("```json\n"), as_json, F.lit("\n```")))
    )
    return e.select("response_id", text.alias("answer"))
