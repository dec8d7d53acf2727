"""Text cleaning and normalising, as column expressions. Patterns keep to what Java and RE2 share, so SQL agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Traces of typesetting in extracted documents.
ARTIFACTS = (
    r"\|[-| ]+\|",
    r"VerDate\s+\S+",
    r"Jkt\s+\d+",
    r"PO\s+\d{5}",
    r"Frm\s+\d+",
    r"Fmt\s+\d+",
    r"Sfmt\s+\d+",
    r"G:\\COMP\\",
)
#: As lines they go whole; this one's mark needs no word behind it.
LINE_ARTIFACTS = tuple(r"VerDate\s+" if p.startswith("VerDate") else p for p in ARTIFACTS)

#: Words of obligation that mark a requirement.
REQUIREMENT_WORDS = (
    "shall", "must", "will", "require", "ensure", "should", "prohibited", "may not", "must not", "is required",
    "are required", "shall not", "must be", "required to", "obligated",
)

#: Words that mark a foundational control.
FOUNDATION_WORDS = (
    "policy", "procedure", "plan", "program", "framework", "establish", "define", "designate", "inventory", "baseline",
    "register", "catalogue", "catalog", "architecture", "strategy", "governance", "charter",
)


def trim_all(text: Column) -> Column:
    """White space of every kind off both ends; Spark's trim takes blanks only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _collapsed(text: Column) -> Column:
    return trim_all(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def clean_tails(text: Column) -> Column:
    """Placeholders go, and each artifact from its mark to the end of its line."""
    text = F.regexp_replace(text, r"\{\{[^}]*\}\}", "")
    return _collapsed(F.regexp_replace(text, "(" + "|".join(ARTIFACTS) + r")[^\n]*", ""))


def clean_lines(text: Column) -> Column:
    """Placeholders go, and every line with an artifact, one kind after the other."""
    text = F.regexp_replace(text, r"\{\{[^\n]*?\}\}", "")
    for pattern in LINE_ARTIFACTS:
        text = F.regexp_replace(text, r"(?m)^[^\n]*" + pattern + r"[^\n]*(\n|\z)", "")
    return _collapsed(text)


def truncated(text: Column, most: int) -> Column:
    """The first ``most`` characters; 0 or less is no limit."""
    return F.substring(text, 1, most) if most > 0 else text


def prepared(text: Column, ancestor: Column, most: int = 0) -> Column:
    """[ancestor] text, cleaned and truncated."""
    named = F.when(F.coalesce(ancestor, F.lit("")) != "", F.concat(F.lit("["), ancestor, F.lit("] "), text)).otherwise(text)
    return truncated(clean_tails(named), most)


def normal_name(name: Column) -> Column:
    """Lower case, no stops at the end, no leading article, single blanks; a lone article is nothing."""
    name = F.regexp_replace(trim_all(F.lower(name)), r"\.+$", "")
    name = trim_all(F.regexp_replace(F.regexp_replace(name, r"^(the|a|an)\s+", ""), r"\s+", " "))
    return F.when(name.isin("the", "a", "an"), "").otherwise(name)


def tokens(name: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(name, r"\s+"), ""))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over those of the shorter name; 0 where one has none."""
    a, b = tokens(a), tokens(b)
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def names_match(a: Column, b: Column, threshold: float = 0.6) -> Column:
    return overlap(a, b) >= threshold


#: Keys of one name in a row, and those of them that are paired at a time: what a task lists for a row is held until it
#: is handed on.
KEYS, AT_ONCE = 1024, 8


def _dealt(names: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by, _name, _at) of each different name with tokens: its tokens in order, and in how many parts the keys that have one are dealt.

    Parts meet two by two, and a key is sent to as many meetings as there are parts. They are as large as leaves about four
    meetings for each of ``n`` tasks, so what is sent grows with the keys and not with their pairs.
    """
    own = names.groupBy(*by, "_name").agg(F.count("_key").alias("_n")).withColumn("_token", F.explode(tokens(F.col("_name"))))
    having = own.groupBy(*by, "_token").agg(F.sum("_n").cast("double").alias("_all"))
    most = having.agg(F.greatest(F.lit(float(KEYS)), F.sqrt(F.sum(F.col("_all") * F.col("_all")) / (8 * n))).alias("_most"))
    having = having.crossJoin(F.broadcast(most)).select(*by, "_token", F.greatest(F.lit(1), F.round(F.col("_all") / F.col("_most")).cast("int")).alias("_parts"))
    at = F.sort_array(F.collect_list(F.struct("_token", "_parts"))).alias("_at")
    return own.join(having, [*by, "_token"]).groupBy(*by, "_name").agg(F.ceil(F.first("_n") / KEYS).alias("_shares"), at)


def matching_pairs(names: DataFrame, key: str, name: str, by: list[str], threshold: float = 0.6) -> DataFrame:
    """(key_a, key_b) of rows of one ``by`` whose names match, key_a < key_b: the same as comparing all, which is not done.

    Of two names the one with fewer tokens has enough of them in common, so if as many of its tokens as may be missing, and
    one more, are looked up among the other's, one is found. A pair that several tokens lead to is taken at the first.

    The list is the square of a name's keys by nature, but only keys are sent: those of a name come in shares of about
    ``KEYS``, which go to each of their tokens. Shares meet and are listed where they arrive, so no two of them are sent
    as a row, and many keys of one token are the work of several tasks.
    """
    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = names.select(*by, F.col(name).alias("_name"), F.col(key).alias("_key"))
    for c in names.columns:
        names = names.where(F.col(c).isNotNull())
    # Merged, since Spark would broadcast the rows of a table that is small in bytes, and one task would get them all.
    shared = names.hint("merge").join(_dealt(names, by, n), [*by, "_name"]).withColumn("_share", F.pmod(F.xxhash64("_key"), "_shares"))
    shares = shared.groupBy(*by, "_name", "_at", "_share").agg(F.sort_array(F.collect_list("_key")).alias("_keys")).where(F.size("_keys") > 0)
    sent = shares.select(*by, "_name", "_share", "_keys", F.col("_at._token").alias("_tokens"), F.inline("_at"))
    sent = sent.withColumn("_part", F.pmod(F.xxhash64("_name", "_share"), "_parts")).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    where = [*by, "_token", "_low", "_high"]
    sent = sent.withColumns({"_low": F.least("_part", "_with"), "_high": F.greatest("_part", "_with")})
    # By number: few bytes can be much work, so Spark must not bring the rows together again. Both sides read what is sent
    # once, as long as they are the same to Spark: so no lambda in ``tokens``, and what explode would ask of ``_keys`` is asked above.
    sent = sent.select(*where, "_name", "_share", "_part", "_tokens", "_keys").repartition(n, *where)
    side = lambda s: sent.select(*where, *[F.col(f"_{c}").alias(f"{c}_{s}") for c in ("name", "share", "part", "tokens", "keys")])
    n_a, n_b, same = F.size("tokens_a"), F.size("tokens_b"), F.col("name_a") == F.col("name_b")
    first = F.slice("tokens_a", 1, F.least(n_a, n_a - F.ceil(F.lit(threshold) * n_a) + 1).cast("int"))
    once = (n_a < n_b) | ((n_a == n_b) & (F.col("name_a") < F.col("name_b"))) | (same & (F.col("share_a") <= F.col("share_b")))
    here = (F.col("part_a") != F.col("part_b")) | (F.col("_low") == F.col("_high"))
    match = F.size(F.array_intersect("tokens_a", "tokens_b")) / F.least(n_a, n_b) >= threshold
    met = side("a").join(side("b"), where).where(here & once & (F.col("_token") == F.array_min(F.array_intersect(first, "tokens_b"))) & match)
    starts = F.sequence(F.lit(1), F.size("keys_a"), F.lit(AT_ONCE))
    one = (same & (F.col("share_a") == F.col("share_b"))).alias("one")
    met = met.select(one, "keys_b", F.explode(F.transform(starts, lambda i: F.slice("keys_a", i, AT_ONCE))).alias("keys_a"))
    pairs = met.select("one", "keys_b", F.explode("keys_a").alias("a")).select("one", "a", F.explode("keys_b").alias("b"))
    return pairs.where((F.col("a") != F.col("b")) & (~F.col("one") | (F.col("a") < F.col("b")))).select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b"))


def matched_words(text: Column, vocabulary: tuple[str, ...]) -> Column:
    """The words of the vocabulary that stand anywhere in the text, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, vocabulary)), lambda w: F.contains(low, w))


def has_any(text: Column, vocabulary: tuple[str, ...]) -> Column:
    """As a chain of substring searches, which stays in generated code."""
    low, found = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for word in vocabulary:
        found = found | F.contains(low, F.lit(word))
    return found


def resolved_prose(text: Column, params: Column) -> Column:
    """Each {{ insert: param, id }} becomes the parameter's value, or [id] without one; other placeholders [parameter].

    The text is split at the placeholders and joined again, so a value that looks like one is left alone.
    """
    marks = F.regexp_extract_all(text, F.lit(r"(\{\{[^\n]*?\}\})"), F.lit(1))

    def value(mark: Column) -> Column:
        name = F.regexp_extract(mark, r"insert:\s*param,\s*([\w\-.]+)", 1)
        known = F.element_at(params, name)
        return F.when(name == "", "[parameter]").otherwise(F.coalesce(known, F.concat(F.lit("["), name, F.lit("]"))))

    values = F.concat(F.transform(marks, value), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(text, r"\{\{[^\n]*?\}\}", -1), values, lambda piece, v: F.concat(piece, v)), "")


def collected_params(catalog: Column, control: Column) -> Column:
    """Parameter values by id; the control's own win over the catalog's, blank ones are left out."""
    filled = lambda m: F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: F.trim(v) != "")
    own, rest = filled(control), filled(catalog)
    return F.map_concat(F.map_filter(rest, lambda k, v: ~F.map_contains_key(own, k)), own)
