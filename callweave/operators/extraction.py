"""Field extraction and speaker labelling by fixed rules.

The rules find less than a language model does: contact data and order numbers exactly, names, products and
reasons only in set phrases or when they equal a dictionary entry. ``model.map_model`` runs a model instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from callweave import schemas
from callweave.functions.shapes import parse_extraction, segments
from callweave.functions.text import any_of, col, long_enough, missing
from callweave.operators.model import Models
from callweave.operators.similarity import tokens

# One pattern per field; group 1 is the value.
PATTERNS: dict[str, str] = {
    "customer_name": r"(?:[Mm]y name is|[Tt]his is) ([A-Z][\w#'-]*(?: [A-Z][\w#'-]*)*)",
    "customer_phone": r"(\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}|\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|phone is [0-9]{7,12})",
    "customer_email": r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})",
    "order_number": r"(ORD-[0-9A-Z]+(?:-[0-9A-Z]+)*)",
    "product_name": r"(?:calling about|bought|ordered|purchased) (?:my |the |a |an |some )?([^.,;!?]+)",
    "issue_description": r"(?:problem|issue) is (?:that )?([^.!?]+)",
    "resolution_requested": r"(?:I would like|I'd like|I want) (?:a |an |to get )?([^.!?]+)",
    "shipping_address": r"(?:[Ss]hip it to|[Mm]y address is) ([^.!?;]+)",
    "return_reason": r"(?:returning it|return it|sending it back) because ([^.!?]+)",
}
PHONE_LEAD = "phone is "
# No pattern matches without one of its texts. Looking for these first spares most texts the pattern.
NEEDED: dict[str, tuple[str, ...]] = {
    "customer_name": ("y name is ", "his is "),
    "customer_phone": ("-", PHONE_LEAD),
    "customer_email": ("@",),
    "order_number": ("ORD-",),
    "product_name": ("calling about ", "bought ", "ordered ", "purchased "),
    "issue_description": ("problem is ", "issue is "),
    "resolution_requested": ("I would like ", "I'd like ", "I want "),
    "shipping_address": ("hip it to ", "y address is "),
    "return_reason": ("because ",),
}


def pattern_field(text: Column | str, field: str) -> Column:
    """The first hit of a field's pattern in the whole text, NULL without one."""
    hit = F.regexp_extract(col(text), PATTERNS[field], 1)
    if field == "customer_phone":
        hit = F.replace(hit, F.lit(PHONE_LEAD), F.lit(""))
    worth_it = any_of([F.contains(col(text), F.lit(n)) for n in NEEDED[field]])
    return F.when(worth_it, F.nullif(hit, F.lit("")))


def extract_fields(transcripts: DataFrame, products: DataFrame | None = None, text: str = "full_transcript",
                   models: Models | None = None) -> DataFrame:
    """The nine fields of every call. With ``products``, calls without a set phrase take the catalogue name that
    their text mentions. A model in ``models`` reads the text instead; what is no JSON gives no fields."""
    keep = [c for c in transcripts.columns if c != text]
    if models and models.extract:
        answered = models.answers.ask(transcripts, models.extract, "extract", [text])
        return answered.select(*keep, parse_extraction("result").alias("__fields")).select(*keep, "__fields.*")
    fields = transcripts.select(*keep, text, *[pattern_field(text, f).alias(f) for f in schemas.FIELDS])
    if products is None:
        return fields.drop(text)
    open_calls = fields.filter(F.col("product_name").isNull()).select("call_id", text)
    found = mentioned_names(open_calls, products.select("name"), text).select("call_id", F.col("name").alias("__product"))
    return fields.drop(text).join(found, "call_id", "left").withColumn(
        "product_name", F.coalesce("product_name", "__product")).drop("__product")


def mentioned_names(texts: DataFrame, names: DataFrame, text: str = "full_transcript") -> DataFrame:
    """The dictionary name each text mentions as whole words: the longest, then the first in the text.

    Texts are cut into word sequences of the lengths that occur among the names, and these are looked up by
    equality before anything is grouped. The driver sees the distinct lengths only.
    """
    entries = names.distinct().select("name", tokens("name").alias("words")).filter(F.size("words") > 0)
    entries = entries.groupBy(F.array_join("words", " ").alias("phrase"), F.size("words").alias("n")).agg(
        F.min("name").alias("name"))
    sizes = sorted(r[0] for r in entries.select("n").distinct().collect())
    words = F.col("words")

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
        found = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, F.lit(n)), " ").alias("phrase"), i.alias("at")))
        return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<struct<phrase:string,at:int>>"))

    phrases = F.flatten(F.array(*[of_length(n) for n in sizes or [1]]))
    places = texts.select("call_id", tokens(text).alias("words")).select("call_id", F.inline(phrases))
    hits = places.join(entries, "phrase").groupBy("call_id").agg(
        F.min(F.struct((-F.col("n")).alias("shorter"), "at", "name")).alias("hit"))
    return hits.select("call_id", "hit.name")


# Phrases of an agent and of a caller.
AGENT_CUES = r"(?i)(how can i help|how may i help|may i have|can i have|could you|can you|thank you for calling|let me|we can|i can offer|anything else|i apologi[sz]e)"
CALLER_CUES = r"(?i)(my name is|my email|my phone|my order|my address|i bought|i ordered|i received|i would like|i'd like|i want)"
SENTENCE = r"([^.!?]+[.!?]*\s*|[.!?]+\s*)"


def label_speakers(chunks: DataFrame, text: str = "transcript_text", role: str | None = None, models: Models | None = None) -> DataFrame:
    """Speaker segments of each chunk as an array column ``segments``.

    A source with roles keeps them. Otherwise sentences with an agent's phrase, and questions, are the agent's
    unless they hold a caller's phrase; neighbours of one speaker form one segment. The texts of a chunk's segments
    add up to the chunk. Chunks below five characters stay whole, as do those for which a model in ``models`` gives no segments.
    """
    if models and models.label:
        long = F.coalesce(long_enough(text, 5), F.lit(False))
        answered = models.answers.ask(chunks.filter(long), models.label, "label", [text])
        short = chunks.filter(~long).withColumn("result", F.lit(None).cast("string"))
        both = answered.select(*chunks.columns, "result").unionByName(short)
        return both.withColumn("segments", segments(text, "result")).drop("result")
    whole = F.array(F.struct(F.lit("caller").alias("speaker"), F.col(text).alias("text")))
    if role is not None:
        who = F.when(F.lower(role) == "agent", "agent").otherwise("caller")
        return chunks.withColumn("segments", F.array(F.struct(who.alias("speaker"), F.col(text).alias("text"))))

    def label(sentence: Column) -> Column:
        agent = (F.regexp_like(sentence, F.lit(AGENT_CUES)) | F.contains(sentence, F.lit("?"))) & ~F.regexp_like(
            sentence, F.lit(CALLER_CUES))
        return F.struct(F.when(agent, "agent").otherwise("caller").alias("speaker"), sentence.alias("text"))

    labelled = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(1)), label)

    def once(value: Column, body: Callable[[Column], Column]) -> Column:
        """``body`` of ``value``, which is worked out once."""
        return F.transform(F.array(value), body)[0]

    def slices(sentences: Column) -> Column:
        """One slice of sentences from each change of the speaker to the next."""
        changes = F.filter(F.transform(sentences, lambda s, i: F.when(
            (i == 0) | (s["speaker"] != F.try_element_at(sentences, F.greatest(i, F.lit(1)))["speaker"]), i + 1)), lambda i: i.isNotNull())

        def cut(starts: Column) -> Column:
            def segment(i: Column, k: Column) -> Column:
                own = F.slice(sentences, i, F.coalesce(F.try_element_at(starts, k + 2), F.size(sentences) + 1) - i)
                return F.struct(own[0]["speaker"].alias("speaker"), F.array_join(own["text"], "").alias("text"))
            return F.transform(starts, segment)
        return once(changes, cut)

    merged = once(labelled, slices)
    return chunks.withColumn("segments", F.when(
        ~missing(text) & long_enough(text, 5) & (F.size(merged) > 0), merged).otherwise(whole))
