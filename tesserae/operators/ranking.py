"""Fusion and re-ranking. Every stage takes and returns (query_id, chunk_ord, score), for any number of queries.

`meta` is the chunk table with `chunk_meta`'s columns; `plans` the analysed queries, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import paths as P
from ..functions import text as T
from ..functions import vectors as V
from ..plans.query import HINTS

def _per_query():
    return Window.partitionBy("query_id")


def chunk_meta(chunks: DataFrame) -> DataFrame:
    """What ranking needs of a chunk and no query changes: worked out once, at index time."""
    stem = F.lower(T.stem("file_path"))
    up = T.parent("file_path")
    own = T.split_identifier(T.stem("file_path"))
    above = F.when(up.isin("", ".", ".."), F.array().cast("array<string>")).otherwise(T.split_identifier(up))
    return chunks.select(
        "*",
        stem.alias("stem"),
        F.array_distinct(F.concat(own, above)).alias("path_parts"),
        P.penalty("file_path").alias("path_penalty"),
        P.is_package_entry("content").alias("package_entry"),
        P.is_entry_point("content").alias("entry_like"),
        P.is_installer("file_path").alias("installer"),
    )


def rrf(ranked: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """score -> 1 / (rrf_k + rank), by the rank that `top_k` gave."""
    return ranked.select("query_id", "chunk_ord", (1 / (config.rrf_k + F.col("rank"))).alias("score"))


def fuse(semantic: DataFrame, lexical: DataFrame, plans: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """alpha * semantic + (1 - alpha) * lexical over the union of both hit lists (a full join as one aggregation)."""
    both = rrf(semantic, config).withColumn("sem", F.lit(True)).unionByName(rrf(lexical, config).withColumn("sem", F.lit(False)))
    both = both.join(plans.select("query_id", "alpha"), "query_id")
    part = F.when(F.col("sem"), F.col("alpha") * F.col("score")).otherwise((1 - F.col("alpha")) * F.col("score"))
    return both.groupBy("query_id", "chunk_ord").agg(F.sum(part).alias("score"))


def coherence(scores: DataFrame, meta: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The best chunk of each file gains in proportion to its file's summed score."""
    s = scores.join(meta.select("chunk_ord", "file_path", "start_line"), "chunk_ord")
    in_file = Window.partitionBy("query_id", "file_path")
    s = s.withColumn("file_sum", F.sum("score").over(in_file)).withColumn("nth", F.row_number().over(in_file.orderBy(F.desc("score"), "start_line", "chunk_ord")))
    top, most = F.max("score").over(_per_query()), F.max("file_sum").over(_per_query())
    s = s.withColumn("top", top).withColumn("most", most)
    gain = F.when((F.col("nth") == 1) & (F.col("top") != 0), config.coherence_boost * F.col("top") * F.col("file_sum") / F.col("most")).otherwise(0.0)
    return s.select("query_id", "chunk_ord", (F.col("score") + gain).alias("score"))


def _stem_is(stem: Column, names: Column) -> Column:
    bare = F.replace(stem, F.lit("_"), F.lit(""))
    forms = F.array(stem, bare, F.regexp_replace(stem, r"s\z", ""), F.regexp_replace(bare, r"s\z", ""))
    return F.arrays_overlap(forms, names)


def _defines(content: Column) -> Column:
    return (F.size("names") > 0) & (F.regexp_like(content, F.col("def_pattern")) | F.regexp_like(content, F.col("sql_pattern")))


def _tier(unit: Column) -> Column:
    """What a definition of one of the query's names is worth in this chunk."""
    return F.when(_defines(F.col("content")), unit * F.when(_stem_is(F.col("stem"), F.col("names_low")), 1.5).otherwise(1.0)).otherwise(0.0)


def _keyword_matches() -> Column:
    """Keywords that are a part of the path, or share a prefix of three characters or more with one, as whole shorter word."""
    close = lambda k, p: ((F.length(k) <= F.length(p)) & (F.length(k) >= 3) & F.startswith(p, k)) | ((F.length(p) < F.length(k)) & (F.length(p) >= 3) & F.startswith(k, p))
    return F.size(F.filter("keywords", lambda k: F.exists("path_parts", lambda p: (k == p) | close(k, p))))


def _injected(plans: DataFrame, meta: DataFrame, config: EngineConfig) -> DataFrame:
    """Chunks whose file is named like a queried symbol: an equi-join on forms of the stem."""
    bare = F.replace("stem", F.lit("_"), F.lit(""))
    forms = F.array_distinct(F.array(F.col("stem"), bare, F.regexp_replace("stem", r"s\z", ""), F.regexp_replace(bare, r"s\z", "")))
    whole = meta.select("chunk_ord", F.explode(forms).alias("form"))
    asked = plans.where("symbol").select("query_id", F.explode("names_low").alias("form")).distinct()
    symbols = whole.join(asked, "form").select("query_id", "chunk_ord")
    # Inside a sentence a stem may also be a beginning of the symbol, of four characters or more.
    named = plans.where("NOT symbol").select("query_id", F.explode("names_low").alias("name"))
    least = config.embedded_stem_min
    begins = F.when(F.length("name") > least, F.transform(F.sequence(F.lit(least), F.greatest(F.lit(least), F.length("name"))), lambda i: F.substring("name", F.lit(1), i))).otherwise(F.array().cast("array<string>"))
    begun = named.select("query_id", F.explode(F.array_distinct(F.concat(F.array("name"), begins))).alias("form")).distinct()
    either = meta.select("chunk_ord", F.explode(F.array_distinct(F.array(F.col("stem"), bare))).alias("form"))
    embedded = either.join(begun, "form").select("query_id", "chunk_ord")
    return symbols.unionByName(embedded).distinct()


def _first_of_alike(rows: DataFrame, *, most: str | int) -> DataFrame:
    """(query_id, chunk_ord): of a query's chunks that no search found, the first `most` of each file and gain.

    The rows (query_id, chunk_ord, file_path, start_line, package_entry, entry_like) of a query, a file and one pair of
    these marks gain the same unfound, and no less if a search finds them, so each stands behind all before it, whatever
    was found: one that `most` others precede is not among the query's best `most`, nor lifts or lowers one that is."""
    nth = F.row_number().over(Window.partitionBy("query_id", "file_path", "package_entry", "entry_like").orderBy("start_line", "chunk_ord"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= (F.col(most) if isinstance(most, str) else most)).select("query_id", "chunk_ord")


def named_candidates(meta: DataFrame, plans: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, chunk_ord): chunks of files named like a queried symbol that can come into its query's top k unfound.

    Only those that define the symbol come in at all, and of a file and gain only the first `top_k`."""
    named = _injected(plans, meta, config).join(plans.select("query_id", "top_k", "names", "def_pattern", "sql_pattern"), "query_id")
    named = named.join(meta.select("chunk_ord", "content", "file_path", "start_line", "package_entry", "entry_like"), "chunk_ord")
    return _first_of_alike(named.where(_defines(F.col("content"))), most="top_k")


def _definition_gain(config: EngineConfig) -> Column:
    unit = F.col("top") * config.definition_boost * F.when(F.col("symbol"), 1.0).otherwise(config.embedded_scale)
    return F.when(F.col("defines"), unit * F.when(F.col("stem_named"), 1.5).otherwise(1.0)).otherwise(0.0)


def _share() -> Column:
    """Of a sentence's keywords, the share found in the file's name or folder."""
    return F.when(~F.col("symbol") & (F.size("keywords") > 0), _keyword_matches() / F.size("keywords"))


def _stem_gain(config: EngineConfig) -> Column:
    return F.when(F.col("share") >= 0.1, F.col("top") * config.stem_boost * F.col("share")).otherwise(0.0)


def _exact_hit() -> Column:
    """A word of a sentence that is the file's name. Generic words are out; if the sentence hints at an
    implementation file that exists in the corpus (`present`), other exact names gain nothing."""
    prefer = F.arrays_overlap("hints", "present")
    bare = lambda x: F.regexp_replace(x, "[-_]", "")
    hit = F.exists("exact_words", lambda w: ~(prefer & (w == F.col("stem")) & ~F.col("stem").isin(*HINTS)) & ((w == F.col("stem")) | (bare(w) == bare(F.col("stem")))))
    return ~F.col("symbol") & hit


def _exact_gain(hit: Column, config: EngineConfig) -> Column:
    return F.when(hit, F.col("top") * config.exact_stem_boost).otherwise(0.0)


def _location_worth(config: EngineConfig) -> Column:
    """An entry point, for a sentence that asks where something is: the share of `top` it gains."""
    worth = F.when(F.col("package_entry"), F.when(F.col("entry_point"), config.location_boost).otherwise(config.package_entry_boost))
    worth = worth.when(F.col("entry_point") | _named_by(F.col("stem")), config.location_boost).otherwise(0.0)
    return F.when(F.col("location") & ~F.col("symbol") & F.col("entry_like"), worth).otherwise(0.0)


def _installer_factor(config: EngineConfig) -> Column:
    return F.when(F.col("location") & ~F.col("integration") & ~F.col("symbol") & F.col("installer"), config.installer_penalty).otherwise(1.0)


def _present(corpus: DataFrame) -> DataFrame:
    """One row: the hinted names that the corpus has files of; as many as there are hints."""
    return corpus.where(F.col("stem").isin(*HINTS)).agg(F.collect_set("stem").alias("present"))


def _named_by(stem: Column) -> Column:
    bare = lambda x: F.regexp_replace(x, "[-_]", "")
    inside = F.exists("words", lambda w: w.contains("-") & F.array_contains(F.split(w, "-"), stem))
    return F.array_contains("words", stem) | (~inside & F.exists("words", lambda w: bare(w) == bare(stem)))


def entry_candidates(meta: DataFrame, plans: DataFrame, top: int, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, chunk_ord): the entry points that a location query can bring in though no search found them.

    All that come in unfound gain the same, so a query's order among them is fixed by penalties, halving within a file,
    line and number alone, and one that `top` others precede there cannot reach a top `top`: found chunks only
    push it down. That order is the same for all queries of a kind, so each kind takes its first `top`. Entry points that
    a query names are met by name."""
    asked = plans.where("location AND NOT symbol").select("query_id", "entry_point", (~F.col("integration")).alias("lose"), (F.col("alpha") >= 1).alias("flat"), "words")
    entries = meta.where("entry_like").select("chunk_ord", "file_path", "start_line", "stem", "package_entry", "installer", "path_penalty")
    flags = F.array(F.lit(True), F.lit(False))
    pool = entries.withColumn("entry_point", F.explode(flags)).where("entry_point OR package_entry").withColumn("lose", F.explode(flags)).withColumn("flat", F.explode(flags))
    pool = pool.withColumn("pen", F.when(F.col("lose") & F.col("installer"), config.installer_penalty).otherwise(1.0) * F.when(F.col("flat"), 1.0).otherwise(F.col("path_penalty")))
    kind = ["entry_point", "lose", "flat"]
    nth = F.row_number().over(Window.partitionBy(*kind, "file_path").orderBy(F.desc("pen"), "start_line", "chunk_ord"))
    pool = pool.withColumn("nth", nth).where(F.col("nth") <= top).withColumn("worth", F.col("pen") * F.pow(F.lit(config.saturation_decay), F.col("nth") - 1))
    place = F.row_number().over(Window.partitionBy(*kind).orderBy(F.desc("worth"), F.desc("pen"), "start_line", "chunk_ord"))
    first = pool.withColumn("place", place).where(F.col("place") <= top).select(*kind, "chunk_ord")
    bare = lambda x: F.regexp_replace(x, "[-_]", "")
    words = asked.select("query_id", "words", F.explode("words").alias("word")).withColumn("form", bare("word"))
    named = entries.withColumn("form", bare("stem")).join(words, "form").where(_named_by(F.col("stem"))).withColumn("entry_like", F.lit(True))
    named = named.dropDuplicates(["query_id", "chunk_ord"])  # words of one form
    return asked.join(first, kind).select("query_id", "chunk_ord").unionByName(_first_of_alike(named, most=top)).distinct()


def candidates(scores: DataFrame, meta: DataFrame, plans: DataFrame, config: EngineConfig = DEFAULT, entries: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_ord, score (null if no search found it), named, entry: all that may be in a query's answer.

    Beside what was found these are files named like a queried symbol (`named`, or all of them) and `entries`, entry points
    that may come in."""
    flag = lambda df, named, entry: df.select("query_id", "chunk_ord", F.lit(None).cast("double").alias("score"), F.lit(named).alias("named"), F.lit(entry).alias("entry"))
    both = scores.select("query_id", "chunk_ord", "score", F.lit(False).alias("named"), F.lit(False).alias("entry")).unionByName(flag(_injected(plans, meta, config) if named is None else named, True, False))
    if entries is not None:
        both = both.unionByName(flag(entries, False, True))
    return both.groupBy("query_id", "chunk_ord").agg(F.max("score").alias("score"), F.max("named").alias("named"), F.max("entry").alias("entry"))


_PLAN = ["query_id", "top_k", "alpha", "symbol", "names", "names_low", "def_pattern", "sql_pattern", "keywords", "exact_words", "words", "location", "entry_point", "integration", "hints"]


def boosted(scores: DataFrame, meta: DataFrame, plans: DataFrame, config: EngineConfig = DEFAULT, entries: DataFrame | None = None, digits: int | None = None, named: DataFrame | None = None) -> DataFrame:
    """Coherence, then all query boosts, in their order; each reads the best score from before the first of them.

    One pass: candidates meet their query's plan and their chunk once, and every boost is a column. What texts and
    patterns decide is decided once a row, before the windows, which sort and hold no text. Chunks that no
    search found come in if they define a queried name (all such, or of `named`), or as entry points of `entries`. `digits`: to round coherent
    and final scores to, so that any engine orders them alike. Keeps what `saturated` reads."""
    cut = (lambda c: c) if digits is None else (lambda c: V.rounded(c, digits))
    if entries is None and config.improvements:
        entries = entry_candidates(meta, plans, 1 << 30, config)
    s = candidates(scores, meta, plans, config, entries if config.improvements else None, named)
    s = s.join(meta.select("chunk_ord", "content", "file_path", "start_line", "stem", "path_parts", "path_penalty", "package_entry", "entry_like", "installer"), "chunk_ord").join(plans.select(*_PLAN), "query_id")
    marks = {"defines": _defines(F.col("content")), "stem_named": _stem_is(F.col("stem"), F.col("names_low")), "share": _share()}
    if config.improvements:
        s = s.join(F.broadcast(_present(meta)))
        marks |= {"exact": _exact_hit(), "location_worth": _location_worth(config), "factor": _installer_factor(config)}
    s = s.select("query_id", "chunk_ord", "score", "named", "entry", "file_path", "start_line", "path_penalty", "alpha", "top_k", "symbol", *(c.alias(k) for k, c in marks.items()))
    found = F.col("score").isNotNull()
    in_file = Window.partitionBy("query_id", "file_path")
    nth = F.row_number().over(in_file.orderBy(F.desc_nulls_last("score"), "start_line", "chunk_ord"))
    s = s.withColumns({"found": found, "file_sum": F.sum("score").over(in_file), "nth": nth})
    s = s.withColumns({"best": F.max("score").over(_per_query()), "most": F.max("file_sum").over(_per_query())})
    gain = F.when((F.col("nth") == 1) & (F.col("best") != 0), config.coherence_boost * F.col("best") * F.col("file_sum") / F.col("most")).otherwise(0.0)
    s = s.withColumn("score", F.when(F.col("found"), cut(F.col("score") + gain)))
    s = s.withColumn("top", F.max("score").over(_per_query()))
    defines = _definition_gain(config)
    s = s.withColumn("score", F.when(F.col("found"), F.col("score") + _stem_gain(config) + defines).when(F.col("named") & (defines > 0), defines))
    if config.improvements:
        s = s.withColumn("score", F.col("score") + _exact_gain(F.col("exact"), config))
        there = F.col("top") * F.col("location_worth")
        s = s.withColumn("score", F.when(F.col("score").isNotNull(), F.col("score") + there).when(F.col("entry") & (there > 0), there))
        s = s.withColumn("score", F.col("score") * F.col("factor"))
    return s.where(F.col("score").isNotNull()).select("query_id", "chunk_ord", cut(F.col("score")).alias("score"), "file_path", "start_line", "path_penalty", "alpha", "top_k")


def exact_stems(scores: DataFrame, meta: DataFrame, plans: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The gain of exact names alone, for scores with `top`, the query's best score before any boost."""
    joined = scores.join(plans.select("query_id", "symbol", "exact_words", "hints"), "query_id").join(meta.select("chunk_ord", "stem"), "chunk_ord").join(F.broadcast(_present(meta)))
    return joined.select("query_id", "chunk_ord", (F.col("score") + _exact_gain(_exact_hit(), config)).alias("score"), "top")


def saturated(scores: DataFrame, meta: DataFrame, plans: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Path penalties (unless alpha is 1) and halving for each further chunk of a file, then the top k.

    The greedy selection with its early stop has this closed form: the n-th best chunk of a file is
    worth decay ** (n - 1) of its score, and nothing that the greedy loop never looks at can enter."""
    s = scores
    if "path_penalty" not in s.columns:  # `boosted` keeps these
        s = s.join(meta.select("chunk_ord", "file_path", "start_line", "path_penalty"), "chunk_ord").join(plans.select("query_id", "alpha", "top_k"), "query_id")
    s = s.withColumn("pen", F.col("score") * F.when(F.col("alpha") < 1, F.col("path_penalty")).otherwise(1.0))
    nth = F.row_number().over(Window.partitionBy("query_id", "file_path").orderBy(F.desc("pen"), "start_line", "chunk_ord"))
    s = s.withColumn("score", F.col("pen") * F.pow(F.lit(config.saturation_decay), nth - 1))
    rank = F.row_number().over(_per_query().orderBy(F.desc("score"), F.desc("pen"), "start_line", "chunk_ord"))
    return s.withColumn("rank", rank).where("rank <= top_k").select("query_id", "chunk_ord", "score", "rank")


def plain_top(scores: DataFrame, meta: DataFrame, plans: DataFrame) -> DataFrame:
    """The top k without re-ranking."""
    s = scores.join(meta.select("chunk_ord", "start_line"), "chunk_ord").join(plans.select("query_id", "top_k"), "query_id")
    rank = F.row_number().over(_per_query().orderBy(F.desc("score"), "start_line", "chunk_ord"))
    return s.withColumn("rank", rank).where("rank <= top_k").select("query_id", "chunk_ord", "score", "rank")


def dedupe_by_file(hits: DataFrame) -> DataFrame:
    """The best hit of each file (query_id, chunk_ord, file_path, score, rank)."""
    nth = F.row_number().over(Window.partitionBy("query_id", "file_path").orderBy(F.desc("score"), "rank"))
    return hits.withColumn("nth", nth).where("nth = 1").drop("nth")
