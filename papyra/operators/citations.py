"""Machine-checked citations [[doc_id:start-end]] in answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import SPACE, strip

#: The form of a citation, any bracketed reference, and the reasons a check gives.
CITATION, BRACKETED, BODY = r"\[\[(\d+):(\d+)-(\d+)\]\]", r"\[\[([^\[\]]*)\]\]", r"^\d+:\d+-\d+$"
UNKNOWN, EMPTY, OUTSIDE, NOT_FOUND, NO_QUOTE, MALFORMED = "unknown document", "empty or inverted range", "range outside the document", "quote not found in the range", "no quote given", "not doc_id:start-end"


def cited(answers: DataFrame, text: str = "answer") -> DataFrame:
    """(answer_id, nr, doc_id, char_start, char_end, key) of every citation in order, repeats included."""
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(CITATION), F.lit(k)).alias(n) for k, n in ((1, "d"), (2, "s"), (3, "e"))])
    rows = answers.select("answer_id", F.posexplode(parts).alias("nr", "x"))
    return rows.select("answer_id", "nr", F.col("x.d").try_cast("long").alias("doc_id"), F.col("x.s").try_cast("long").alias("char_start"), F.col("x.e").try_cast("long").alias("char_end"), F.concat("x.d", F.lit(":"), "x.s", F.lit("-"), "x.e").alias("key"))


def malformed(answers: DataFrame, text: str = "answer") -> DataFrame:
    """(answer_id, raw): bracketed references of another form, stripped, each once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(BRACKETED), F.lit(1)), strip)
    return answers.select("answer_id", F.explode(F.array_distinct(F.filter(found, lambda x: ~x.rlike(BODY)))).alias("raw"))


def resolved(cites: DataFrame, docs: DataFrame) -> DataFrame:
    """cites with known, size and fragment (null unless 0 <= start < end <= size)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("whole"))
    rows = cites.join(d, "doc_id", "left").withColumns({"known": F.col("whole").isNotNull(), "size": F.length("whole")})
    ok = (F.col("char_start") >= 0) & (F.col("char_start") < F.col("char_end")) & (F.col("char_end") <= F.col("size"))
    return rows.withColumn("fragment", F.when(ok, F.expr("substring(whole, cast(char_start + 1 as int), cast(char_end - char_start as int))"))).drop("whole")


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def checked(rows: DataFrame, quote: Column | None = None) -> DataFrame:
    """resolved rows with reason: null if the citation (and the quote, if given) holds."""
    reason = (
        F.when(~F.col("known"), UNKNOWN)
        .when((F.col("char_start") < 0) | (F.col("char_start") >= F.col("char_end")), EMPTY)
        .when(F.col("char_end") > F.col("size"), OUTSIDE)
    )
    if quote is not None:
        reason = reason.when(~F.contains(normal(F.col("fragment")), normal(quote)), NOT_FOUND)
    return rows.withColumn("reason", reason)


def normal_key(key: Column) -> Column:
    return F.trim(F.btrim(F.trim(key), F.lit("[]")))


def verify(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """Per answer(answer_id, answer, quotes map): counts and shares of resolvable and verbatim references.

    References are distinct citations and malformed ones, which neither resolve nor quote. A citation
    without a quote is not verbatim. failures lists (citation, reason); no reference: shares are null.
    """
    cites = cited(answers)
    counts = cites.groupBy("answer_id").agg(F.count("*").alias("citations"))
    once = cites.groupBy("answer_id", "key").agg(F.min("nr").alias("nr"), F.any_value("doc_id").alias("doc_id"), F.any_value("char_start").alias("char_start"), F.any_value("char_end").alias("char_end"))
    quotes = answers.select("answer_id", F.explode("quotes").alias("k", "quote")).select("answer_id", normal_key(F.col("k")).alias("key"), "quote").groupBy("answer_id", "key").agg(F.max("quote").alias("quote"))
    rows = resolved(once, docs).join(quotes, ["answer_id", "key"], "left")
    rows = checked(rows).withColumn("resolves", F.col("reason").isNull()).drop("reason")
    rows = checked(rows, F.col("quote")).withColumn("reason", F.when(F.col("quote").isNull(), NO_QUOTE).otherwise(F.col("reason")))
    per = rows.groupBy("answer_id").agg(
        F.count("*").alias("unique_citations"), F.count_if("resolves").alias("resolvable"), F.count_if(F.col("reason").isNull()).alias("quote_verbatim"),
        F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("nr", F.col("key").alias("citation"), "reason")))).alias("bad"),
    )
    broken = malformed(answers).groupBy("answer_id").agg(F.count("*").alias("malformed_citations"), F.sort_array(F.collect_list("raw")).alias("raws"))
    out = answers.select("answer_id").join(counts, "answer_id", "left").join(per, "answer_id", "left").join(broken, "answer_id", "left")
    out = out.fillna(0, ["citations", "unique_citations", "resolvable", "quote_verbatim", "malformed_citations"])
    total = F.col("unique_citations") + F.col("malformed_citations")
    kind = "array<struct<citation:string,reason:string>>"
    bad = F.coalesce(F.transform("bad", lambda x: F.struct(x["citation"].alias("citation"), x["reason"].alias("reason"))), F.array().cast(kind))
    raws = F.coalesce(F.transform("raws", lambda x: F.struct(x.alias("citation"), F.lit(MALFORMED).alias("reason"))), F.array().cast(kind))
    share = lambda c: F.round(F.col(c) / F.nullif(total, F.lit(0)), 4)
    return out.select("answer_id", "citations", "unique_citations", "malformed_citations", total.alias("references_total"), "resolvable", share("resolvable").alias("resolvable_share"), "quote_verbatim", share("quote_verbatim").alias("quote_verbatim_share"), F.concat(bad, raws).alias("failures"))


def summary(rows: DataFrame) -> DataFrame:
    """One row over answers(refused, error, verification columns): pooled counts and shares."""
    answered = ~F.col("refused") & F.col("error").isNull()
    pooled = lambda c: F.coalesce(F.sum(F.when(answered, F.col(c))), F.lit(0))
    return rows.agg(
        F.count("*").alias("questions"), F.count_if(answered).alias("answered"), F.count_if("refused").alias("refused"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        pooled("references_total").alias("references_total"), pooled("resolvable").alias("resolvable"), pooled("quote_verbatim").alias("quote_verbatim"),
        F.round(pooled("resolvable") / F.nullif(pooled("references_total"), F.lit(0)), 4).alias("resolvable_share"),
        F.round(pooled("quote_verbatim") / F.nullif(pooled("references_total"), F.lit(0)), 4).alias("quote_verbatim_share"),
        F.count_if(answered & (F.col("quote_verbatim_share") == 1)).alias("all_valid"),
    )


def citations_valid(rows: DataFrame) -> DataFrame:
    """rows with valid: an error is not, a refusal is, an answer is if every reference is verbatim."""
    return rows.withColumn("valid", F.when(F.col("error").isNotNull(), False).when(F.col("refused"), True).otherwise(F.coalesce(F.col("quote_verbatim_share") == 1, F.lit(False))))


def reverify(stored: DataFrame, docs: DataFrame) -> DataFrame:
    """stored answers with their verification made anew; refused and failed rows keep the old one."""
    new = verify(stored.where(~F.col("refused") & F.col("error").isNull()).select("answer_id", "answer", "quotes"), docs)
    names = [c for c in new.columns if c != "answer_id"]
    both = stored.join(new.select("answer_id", F.struct(*names).alias("new")), "answer_id", "left")
    return both.withColumns({c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)) for c in names if c in stored.columns}).drop("new")


def fragments(hits: DataFrame, limit: int = 2200) -> DataFrame:
    """(query_id, prompt) of hits(query_id, rank, chunk_id, breadcrumb, text): `[id] crumb`, the text's beginning, ruled off."""
    one = F.concat(F.lit("["), "chunk_id", F.lit("] "), F.coalesce("breadcrumb", F.lit("")), F.lit("\n"), F.substring("text", 1, limit))
    listed = hits.withColumn("one", one).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "one"))).alias("l"))
    return listed.select("query_id", F.array_join("l.one", "\n\n---\n\n").alias("prompt"))
