"""Station names to codes: ordered variants, exact, spaceless and unique-prefix matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import lookup, norm_name, spaceless, trigrams

PREFIX_MIN = 6


def name_variants(raw: Column) -> Column:
    """Ordered array of (text, alias_code): whole name, bracket parts, scrape prefix, JN forms."""
    parts = F.when(
        F.contains(raw, F.lit("(")),
        F.transform(F.filter(F.split(raw, r"\("), lambda p: F.trim(p) != ""), lambda p: norm_name(p)),
    ).otherwise(F.array().cast("array<string>"))
    bases = F.concat(F.array(norm_name(raw)), parts)
    stripped = F.transform(
        F.filter(bases, lambda b: F.startswith(b, F.lit("RL "))), lambda b: F.substring(b, F.lit(4), F.length(b))
    )
    bases = F.filter(F.transform(F.concat(bases, stripped), lambda b: F.trim(b)), lambda b: b != "")
    none = F.lit(None).cast("string")

    def plain(text):
        return F.struct(text.alias("text"), none.alias("alias_code"))

    def spread(b):
        alias = lookup(fixed.STATION_ALIASES, b)
        cut_jn = F.regexp_replace(b, " JN$", "")
        cut_junction = F.regexp_replace(b, " JUNCTION$", "")
        forms = (
            F.when(F.endswith(b, F.lit(" JN")), F.array(plain(cut_jn), plain(F.concat(cut_jn, F.lit(" JUNCTION")))))
            .when(
                F.endswith(b, F.lit(" JUNCTION")),
                F.array(plain(cut_junction), plain(F.concat(cut_junction, F.lit(" JN")))),
            )
            .otherwise(F.array(plain(F.concat(b, F.lit(" JN")))))
        )
        by_alias = F.when(
            alias.isNotNull(), F.array(F.struct(none.alias("text"), alias.alias("alias_code")))
        ).otherwise(F.array().cast("array<struct<text:string,alias_code:string>>"))
        return F.concat(F.array(plain(b)), by_alias, forms)

    return F.flatten(F.transform(bases, spread))


def fix_code(code: Column) -> Column:
    return F.coalesce(lookup(fixed.CODE_RENAMES, code), code)


def name_dictionary(sources: list[DataFrame]) -> DataFrame:
    """First code per normalised name; earlier sources win, then the earlier position.

    Every source has ``name``, ``code`` and ``pos``: a number, or a struct of file, line and position.
    """
    order = "struct<file:string,line:bigint,pos:bigint>"

    def place(df: DataFrame) -> Column:
        whole = df.schema["pos"].dataType.typeName() == "struct"
        return (F.col("pos") if whole else F.struct(F.lit(""), F.lit(0), F.col("pos"))).cast(order)

    ranked = [
        s.select(norm_name(F.col("name")).alias("name"), F.col("code"), F.struct(F.lit(i), place(s), F.col("code")).alias("__o"))
        for i, s in enumerate(sources)
    ]
    every = reduce(DataFrame.unionByName, ranked).filter((F.col("name") != "") & (F.col("code") != ""))
    return every.groupBy("name").agg(F.min_by("code", "__o").alias("code"))


def _prefixes(text: Column, low: int) -> Column:
    return F.when(
        F.length(text) >= low,
        F.transform(F.sequence(F.lit(low), F.length(text)), lambda n: F.left(text, n)),
    ).otherwise(F.array().cast("array<string>"))


def unique_prefix_codes(queries: DataFrame, names: DataFrame, low: int = PREFIX_MIN) -> DataFrame:
    """(key, code) for spaceless queries that lead to exactly one code.

    Names that go on where the query ends are found by an equi-join on every prefix of the names,
    already reduced to the lowest and highest code per prefix. The longest name that starts the query
    is found by an equi-join on every prefix of the query. No block of similar names is paired.
    """
    wanted = queries.select("key").distinct().filter(F.length("key") >= low)
    extending = (
        names.select("code", F.explode(_prefixes(F.col("key"), low)).alias("key"))
        .groupBy("key").agg(F.min("code").alias("lo"), F.max("code").alias("hi"))
    )
    starts = wanted.select("key", F.explode(_prefixes(F.col("key"), low)).alias("start"))
    longest = (
        starts.join(names.select(F.col("key").alias("start"), "code"), "start")
        .groupBy("key").agg(F.max_by("code", F.length("start")).alias("start_code"))
    )
    both = wanted.join(extending, "key", "left").join(longest, "key", "left")
    lo = F.least("lo", "start_code")
    hi = F.greatest("hi", "start_code")
    return both.filter(lo.isNotNull() & (lo == hi)).select("key", lo.alias("code"))


def match_stations(refs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Code per distinct ``raw_name``: the first variant that hits, exact before spaceless before prefix."""
    distinct = refs.select("raw_name").distinct()
    expanded = distinct.select("raw_name", F.posexplode(name_variants(F.col("raw_name"))).alias("pos", "v")).select(
        "raw_name", "pos", F.col("v.text").alias("text"), F.col("v.alias_code").alias("alias_code"),
        spaceless(F.col("v.text")).alias("key"),
    )
    exact = dictionary.select(F.col("name").alias("text"), F.col("code").alias("exact_code"))
    # of names that differ by blanks only, the last in name order is kept
    tight = dictionary.groupBy(spaceless(F.col("name")).alias("key")).agg(F.max_by("code", "name").alias("code"))
    open_keys = expanded.filter(F.col("key").isNotNull()).select("key")
    fuzzy = unique_prefix_codes(open_keys, tight).select("key", F.col("code").alias("fuzzy_code"))
    tight = tight.select("key", F.col("code").alias("tight_code"))
    tried = (
        expanded.join(exact, "text", "left").join(tight, "key", "left").join(fuzzy, "key", "left")
        .withColumn("code", F.coalesce("alias_code", "exact_code", "tight_code", "fuzzy_code"))
        .withColumn(
            "method",
            F.when(F.col("alias_code").isNotNull(), "alias").when(F.col("exact_code").isNotNull(), "exact")
            .when(F.col("tight_code").isNotNull(), "spaceless").when(F.col("fuzzy_code").isNotNull(), "prefix"),
        )
    )
    hit = tried.filter(F.col("code").isNotNull()).groupBy("raw_name").agg(
        F.min_by(F.struct("code", "method"), "pos").alias("m")
    )
    found = hit.select("raw_name", fix_code(F.col("m.code")).alias("code"), F.col("m.method").alias("method"))
    return refs.join(found, "raw_name", "left")


def trigram_matches(queries: DataFrame, names: DataFrame, threshold: float = 0.45) -> DataFrame:
    """(query, name, similarity) of distinct texts with a trigram similarity above the threshold.

    Grams are ordered from rare to common. Two sets of n and m grams above the threshold t share at least
    o = ceil(t * (n + m) / (1 + t)) of them, so they share one among the first n - o + 1 and m - o + 1. Each text
    offers so many grams to each size of partner, and texts meet on (gram, both sizes): grams that all names have
    come last and take no part while the rest of the sets is long enough to decide.
    """
    q = queries.select("query").distinct().withColumn("g", trigrams(F.col("query"))).filter(F.size("g") > 0)
    n = names.select("name").distinct().withColumn("g", trigrams(F.col("name"))).filter(F.size("g") > 0)
    frequency = n.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))

    def offers(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        grams = df.select(key, F.explode("g").alias("gram")).join(frequency, "gram", "left")
        ordered = grams.groupBy(key).agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("o")
        )
        size = F.size("o")
        partners = F.explode(F.sequence(F.ceil(size * threshold).cast("int"), F.floor(size / threshold).cast("int")))
        sized = ordered.withColumn(own, size).withColumn(other, partners)
        # a little less than the bound, so that rounding loses no pair
        least = F.ceil(threshold * (F.col(own) + F.col(other)) / (1 + threshold) - 1e-9)
        offered = F.slice("o", F.lit(1), F.greatest(F.col(own) - least + 1, F.lit(0)).cast("int"))
        return sized.select(key, own, other, F.explode(offered).alias("s")).select(key, own, other, F.col("s.gram").alias("gram"))

    met = offers(q, "query", "q_size", "n_size").join(offers(n, "name", "n_size", "q_size"), ["gram", "q_size", "n_size"])
    sized = met.select("query", "name").distinct().join(q.withColumnRenamed("g", "gq"), "query").join(n.withColumnRenamed("g", "gn"), "name")
    shared = F.size(F.array_intersect("gq", "gn"))
    similarity = shared / (F.size("gq") + F.size("gn") - shared)
    return sized.withColumn("similarity", similarity).filter(F.col("similarity") > threshold).select("query", "name", "similarity")


#: Letters of an indexed piece of a name.
GRAM = 3


def _grams(text: str, size: Column) -> Column:
    """Distinct pieces of a text of a given length; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.filter(F.transform(starts, lambda i: F.substring(text, i, size)), lambda g: F.length(g) == size))


def gram_index(names: DataFrame, sizes: DataFrame, low: int = 2) -> DataFrame:
    """(gram, name, low_name): the pieces of each name, of as many letters as ``sizes`` lists up to GRAM.

    A name of n letters has at most n pieces per size, however long the queries are.
    """
    n = names.select("name").distinct().withColumn("low_name", F.lower("name"))
    sized = n.withColumn("size", F.explode(F.array(*map(F.lit, range(min(low, GRAM), GRAM + 1))))).join(sizes, "size", "left_semi")
    return sized.select(F.explode(_grams("low_name", F.col("size"))).alias("gram"), "name", "low_name")


def substring_matches(queries: DataFrame, names: DataFrame, low: int = 2) -> DataFrame:
    """(query, name, at_start, whole) of distinct texts where the query occurs in the name, any case.

    Names are indexed by their short pieces. A query looks up the one of its pieces that fewest names have, and the names
    found there are compared with the whole query.
    """
    q = queries.select("query").distinct().filter(F.length("query") >= low).withColumn("piece", F.lower("query"))
    q = q.withColumn("size", F.least(F.length("piece"), F.lit(GRAM)))
    index = gram_index(names, q.select("size").distinct(), low)
    frequency = index.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # a piece that no name has finds nothing, and so does its query
    asked = q.select("query", "piece", F.explode(_grams("piece", F.col("size"))).alias("gram")).join(frequency, "gram", "left")
    rarest = asked.groupBy("query", "piece").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("gram"))
    met = index.join(rarest, "gram").filter(F.contains("low_name", F.col("piece")))
    return met.select(
        "query", "name",
        F.startswith("low_name", F.col("piece")).alias("at_start"),
        (F.col("low_name") == F.col("piece")).alias("whole"),
    )
