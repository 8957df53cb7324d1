"""Sentence, phrase and token units with self-information.

Scores come from a frozen table of the corpus (``unigram_model``, ``bigram_model``) or from any
scorer with the same columns. Units of a document are kept as one array per level, so that
thresholds, masks and ordered joins are array expressions in the row and never shuffle again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terseforge.functions import text as T
from terseforge.runtime import durable

#: Bytes of a model table, as measured, up to which it is broadcast.
BROADCAST_BYTES = 64_000_000
#: Keys whose rows are dealt out when a larger table is joined, and reducers for each.
HOT_KEYS, SALTS = 1000, 64
#: Weight of the bigram in the interpolation with the unigram.
WEIGHT = 0.7
#: Boundary words of the default chunker: a phrase ends before and after them.
# Fixed values.
BOUNDARY_WORDS = ("the", "a", "an", "and", "or", "but", "of", "in", "on", "at", "to", "for", "from", "with", "by", "as", "is", "are", "was", "were", "that", "which", "while", "although", "if", "we", "it", "they", "he", "she", "not")


#: Boundary words of the other languages with noun phrases between blanks; "plain" languages have none:
#: there every token is a phrase.
BOUNDARY_WORDS_OF = {
    "en": BOUNDARY_WORDS,
    "de": tuple("der die das den dem des ein eine einen einem einer und oder aber von in im an am auf zu zum zur für mit bei aus als ist sind war waren dass während obwohl wenn wir es sie er nicht".split()),
    "fr": tuple("le la les un une des et ou mais de du dans sur à au aux pour par avec est sont était étaient que qui bien si nous il elle ils elles ne pas".split()),
    "es": tuple("el la los las un una unos unas y o pero de del en a al para por con como es son era eran que aunque si nosotros ello ellos él ella no".split()),
    "pt": tuple("o a os as um uma uns umas e ou mas de do da dos das em no na para por com como é são era eram que embora se nós ele ela eles elas não".split()),
    "ru": tuple("и или но в на к от для из с со по у о об как это был была были что который хотя если мы они он она не".split()),
}
PLAIN_LANGUAGES = ("zh", "ja")


def sentence_rows(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key, sent_idx, sentence."""
    return df.select(key, F.posexplode(T.sentences(text)).alias("sent_idx", "sentence"))


def token_rows(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key, sent_idx, pos, token; tokens of a sentence concatenate to it."""
    return sentence_rows(df, key, text).select(key, "sent_idx", F.posexplode(T.tokens(F.col("sentence"))).alias("pos", "token"))


def token_offsets(rows: DataFrame, key: str) -> DataFrame:
    """Tokens with their start and end in the sentence: a running sum of lengths."""
    w = Window.partitionBy(key, "sent_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end_off", F.sum(F.length("token")).over(w)).withColumn("start_off", F.col("end_off") - F.length("token"))


def unigram_model(rows: DataFrame) -> DataFrame:
    """token, n, self_info: add-one smoothed negative log-probability of every token of the corpus."""
    counts = rows.groupBy("token").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))  # one row
    return counts.join(F.broadcast(total)).select("token", "n", (-F.ln((F.col("n") + 1) / (F.col("all") + F.col("kinds")))).alias("self_info"))


def bigram_model(rows: DataFrame, key: str, weight: float = WEIGHT) -> DataFrame:
    """prev, token, n, self_info: bigrams interpolated with unigrams; a sentence starts after "<s>"."""
    w = Window.partitionBy(key, "sent_idx").orderBy("pos")
    pairs = rows.withColumn("prev", F.coalesce(F.lag("token").over(w), F.lit("<s>"))).groupBy("prev", "token").agg(F.count("*").alias("n"))
    contexts = pairs.groupBy("prev").agg(F.sum("n").alias("n_prev"))
    single = pairs.groupBy("token").agg(F.sum("n").alias("n_token"))
    total = single.agg(F.sum("n_token").alias("all"), F.count("*").alias("kinds"))
    joined = pairs.join(contexts, "prev").join(single, "token").join(F.broadcast(total))
    p = weight * F.col("n") / F.col("n_prev") + (1 - weight) * (F.col("n_token") + 1) / (F.col("all") + F.col("kinds"))
    return joined.select("prev", "token", "n", (-F.ln(p)).alias("self_info"))


def held(model: DataFrame, derived: bool = True) -> tuple[DataFrame, int]:
    """The model table and its size in bytes; one that a plan makes is kept in the shared folder, so that it is made once."""
    kept = durable(model) if derived else model
    texts = [F.octet_length(f.name) for f in kept.schema if f.dataType.typeName() == "string"]
    each = F.lit(16 * len(kept.columns))
    for t in texts:
        each = each + F.coalesce(t, F.lit(0))
    return kept, int(kept.agg(F.coalesce(F.sum(each), F.lit(0)).alias("n")).first()["n"])


def looked_up(rows: DataFrame, table: DataFrame, size: int, keys: list[str], how: str = "inner", broadcast_bytes: int | None = None) -> DataFrame:
    """Rows joined with a table of unique ``keys``: broadcast if its measured size allows it.

    Beyond that both are shuffled, and the rows of the ``HOT_KEYS`` most counted keys, which the
    table's column n names, are dealt out over ``SALTS`` reducers each.
    """
    if size <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        return rows.join(F.broadcast(table.drop("n")), keys, how)
    if "n" not in table.columns:
        return rows.join(table, keys, how)
    hot = F.broadcast(table.orderBy(F.desc("n"), *keys).limit(HOT_KEYS).select(*keys, F.lit(True).alias("__hot")))
    dealt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    left = rows.join(hot, keys, "left").withColumn("__salt", dealt).drop("__hot")
    right = table.join(hot, keys, "left").withColumn("__salt", copies).drop("__hot", "n")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def scored(rows: DataFrame, model: DataFrame, broadcast_bytes: int | None = None, complete: bool = False) -> DataFrame:
    """Token rows with self_info, by ``looked_up``.

    A token that the model has not counted gets what add-one smoothing gives a count of zero, or, where
    the model's scores are not those of its counts, its highest self_info. ``complete`` says that the
    model was counted on these rows, so that none is missing.
    """
    counted = "n" in model.columns
    table, size = held(model.select("token", *["n"] * counted, "self_info"), complete)
    if complete:
        return looked_up(rows, table, size, ["token"], "inner", broadcast_bytes)
    floor = F.coalesce(F.max("self_info"), F.lit(0.0))
    if counted:
        zero, each = F.ln(F.sum("n") + F.count("*")), F.col("self_info") + F.ln(F.col("n") + 1)
        floor = F.when((F.abs(F.min(each) - zero) < 1e-3) & (F.abs(F.max(each) - zero) < 1e-3), zero).otherwise(floor)
    found = looked_up(rows, table, size, ["token"], "left", broadcast_bytes).join(F.broadcast(table.agg(floor.alias("__floor"))))  # one row
    return found.withColumn("self_info", F.coalesce("self_info", "__floor")).drop("__floor")


def chunk_ids(rows: DataFrame, key: str, words: tuple[str, ...] = BOUNDARY_WORDS) -> DataFrame:
    """phrase_idx of each token: a phrase ends where a boundary word or a sign begins or ends."""
    bare = F.lower(F.trim("token"))
    hard = bare.isin(*words) | ~bare.rlike(r"^[\p{L}\p{N}_]")
    w = Window.partitionBy(key, "sent_idx").orderBy("pos")
    starts = F.when(F.coalesce(F.lag("hard").over(w), F.lit(True)) | F.col("hard"), 1).otherwise(0)
    return rows.withColumn("hard", hard).withColumn("starts", starts).withColumn("phrase_idx", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("hard", "starts")


def plain_chunks(rows: DataFrame, key: str, words: tuple[str, ...] = ()) -> DataFrame:
    """Every token a phrase of its own, as for scripts without noun chunks."""
    return rows.withColumn("phrase_idx", F.col("pos").cast("bigint"))


#: Chunkers by name; a registered one adds phrase_idx to token rows.
CHUNKERS = {"boundary": chunk_ids, "plain": plain_chunks}


def aligned(tokens: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Credits token self-information to units that tile the same string: ``keys``, unit, self_info.

    tokens: keys, pos, token, self_info; units: keys, unit, text. A token gives each unit that ends
    inside it an equal share; one inside whose span no unit ends gives its whole to the unit around
    it, unless it is a single blank. A unit's score is the mean of its credits. One sort of the merged
    boundaries per sentence, no range join. Tokens must not be empty.
    """
    ends = tokens.select(*keys, F.col("pos").alias("i"), F.col("token").alias("t"), "self_info", F.lit(1).alias("kind")).unionByName(units.select(*keys, F.col("unit").alias("i"), F.col("text").alias("t"), F.lit(None).cast("double").alias("self_info"), F.lit(0).alias("kind")))
    placed = ends.withColumn("off", F.sum(F.length("t")).over(Window.partitionBy(*keys, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    # A token stands behind the units that end inside it; one order of the merged ends serves all that follows.
    order = Window.partitionBy(*keys).orderBy("off", "kind", "i")
    ahead, behind = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, 0)
    token, unit = F.col("kind") == 1, F.col("kind") == 0
    counted = placed.withColumn("units", F.sum(F.when(unit, 1).otherwise(0)).over(behind))
    before = F.coalesce(F.last(F.when(token, F.col("units")), True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = counted.withColumn("inside", F.when(token, F.col("units") - before))
    both = inside.withColumn("own_unit", F.first(F.when(unit, F.col("i")), True).over(ahead)).withColumn("own", F.first(F.when(token, F.struct("self_info", "inside")), True).over(ahead))
    whole = token & (F.col("inside") == 0) & (F.col("t") != " ")
    credit = F.when(unit, F.col("own.self_info") / F.col("own.inside")).when(whole, F.col("self_info"))
    return both.where(unit | whole).select(*keys, F.when(unit, F.col("i")).otherwise(F.col("own_unit")).alias("unit"), credit.alias("credit")).where("unit is not null").groupBy(*keys, "unit").agg(F.avg("credit").alias("self_info"))


def sentences_cut(sents: DataFrame, key: str) -> DataFrame:
    """key, sent_idx, text, toks: each sentence with its tokens in the row."""
    return sents.select(key, "sent_idx", F.col("sentence").alias("text"), T.tokens(F.col("sentence")).alias("toks"))


def phrases_cut(sents: DataFrame, key: str, words: tuple[str, ...] = BOUNDARY_WORDS) -> DataFrame:
    """key, sent_idx, phrase_idx, text, toks: the phrases of ``chunk_ids``, cut in the row."""
    cut = sents.select(key, "sent_idx", T.tokens(F.col("sentence")).alias("toks"))

    def is_hard(t: Column) -> Column:
        bare = F.lower(F.trim(t))
        return bare.isin(*words) | ~bare.rlike(r"^[\p{L}\p{N}_]")

    flagged = cut.select(key, "sent_idx", "toks", F.transform("toks", is_hard).alias("hard"))
    begun = flagged.where(F.size("toks") > 0).select(key, "sent_idx", "toks", F.filter(F.sequence(F.lit(0), F.size("toks") - 1), lambda i: (i == 0) | F.get("hard", i) | F.get("hard", i - 1)).alias("at"))
    parts = F.transform("at", lambda b, k: F.slice("toks", b + 1, F.coalesce(F.get("at", k + 1), F.size("toks")) - b))
    rows = begun.select(key, "sent_idx", F.posexplode(parts).alias("phrase_idx", "toks"))
    text = F.array_join("toks", "")
    return rows.select(key, "sent_idx", "phrase_idx", F.when((F.col("sent_idx") > 0) & (F.col("phrase_idx") == 0), F.concat(F.lit(" "), text)).otherwise(text).alias("text"), "toks")


def unit_scores(cut: DataFrame, keys: list[str], model: DataFrame, complete: bool = False) -> DataFrame:
    """``keys``, text, self_info of units with their tokens in the row: the mean over the tokens.

    Where the units were dealt out by their document's key, no token moves.
    """
    tokens = scored(cut.select(*keys, "text", F.explode("toks").alias("token")), model, complete=complete)
    return tokens.groupBy(*keys).agg(F.first("text").alias("text"), F.avg("self_info").alias("self_info"))


def sentence_units(tokens: DataFrame, key: str) -> DataFrame:
    """key, sent_idx, text, self_info: the mean over the sentence's tokens."""
    made = tokens.groupBy(key, "sent_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("u"), F.avg("self_info").alias("self_info"))
    return made.select(key, "sent_idx", F.array_join(F.transform("u", lambda x: x["token"]), "").alias("text"), "self_info")


def phrase_units(tokens: DataFrame, key: str, chunker: str = "boundary", lang: str = "en") -> DataFrame:
    """key, sent_idx, phrase_idx, text, self_info; later sentences' first phrases get a blank in front.

    ``lang`` names the boundary words; in a language of ``PLAIN_LANGUAGES`` every token is a phrase.
    """
    if lang not in BOUNDARY_WORDS_OF and lang not in PLAIN_LANGUAGES:
        raise ValueError(f"no chunker for the language {lang!r}; there are {sorted([*BOUNDARY_WORDS_OF, *PLAIN_LANGUAGES])}")
    cut = CHUNKERS["plain" if lang in PLAIN_LANGUAGES else chunker](tokens, key, BOUNDARY_WORDS_OF.get(lang, ()))
    made = cut.groupBy(key, "sent_idx", "phrase_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("u"), F.avg("self_info").alias("self_info"))
    text = F.array_join(F.transform("u", lambda x: x["token"]), "")
    return made.select(key, "sent_idx", "phrase_idx", F.when((F.col("sent_idx") > 0) & (F.col("phrase_idx") == 0), F.concat(F.lit(" "), text)).otherwise(text).alias("text"), "self_info")


def unit_arrays(units: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per document: units array<struct<text, self_info>> in order."""
    packed = F.array_sort(F.collect_list(F.struct(*order, "text", "self_info")))
    return units.groupBy(key).agg(packed.alias("u")).select(key, F.transform("u", lambda x: F.struct(x["text"].alias("text"), x["self_info"].alias("self_info"))).alias("units"))
