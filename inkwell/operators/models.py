"""Outside models as injected callables: prompts in, replies out, each distinct prompt once; without a model, the stated fallback."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.package import ship
from ..sources.shared import shared_folder
from .evidence import align_pairs, grounding_label
from .replies import Gate, Model, called
from .retrieval import inner_product

Embed = Callable[[list[str]], list[list[float]]]


def replies(rows: DataFrame, prompt: Column, model: Model | None, out: str = "reply", gate: Gate = Gate()) -> DataFrame:
    """Add ``out``: the model's reply to each row's prompt; null without a model or a prompt, and where a call fails.

    Equal prompts are sent once, a batch at a time; a failing batch is sent again prompt by prompt. Nothing is kept:
    ``replies.with_replies`` does the same by a store.
    """
    key = f"_{out}_key"
    x = rows.withColumn(key, F.sha2(prompt, 256))
    if model is None:
        return x.withColumn(out, F.lit(None).cast("string")).drop(key)

    ship(rows.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part[out] = [reply for reply, _, _ in called(model, part["_prompt"].tolist(), gate)]
            yield part[[key, out]]

    asked = x.select(key, prompt.alias("_prompt")).where(F.col(key).isNotNull()).dropDuplicates([key])
    return x.join(asked.mapInPandas(run, f"{key} string, {out} string"), key, "left").drop(key)


def expanded(questions: DataFrame, model: Model | None, q_id: str, text: str = "text") -> DataFrame:
    """Rows (q_id, pos, sub_query): each question and the strings of the model's JSON array, trimmed, each once.

    Code fences around the array go. A reply that is no array of that kind, and any element that is no string, adds
    nothing; without a reply the question stands alone. Every string counts, however many there are.
    """
    x = replies(questions.select(q_id, F.trim(text).alias("q")), F.lower("q"), model)
    bare = F.trim(F.regexp_replace("reply", r"```(?:json)?", ""))
    # elements as raw JSON: a string stands in quotes, anything else doesn't
    raw = F.from_json(F.concat(F.lit('{"a":'), bare, F.lit("}")), "a array<variant>", {"mode": "PERMISSIVE"})["a"]
    strings = F.filter(F.transform(F.coalesce(raw, F.array()), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.trim(F.try_variant_get(v, "$", "string")))), lambda s: s != "")
    all_ = F.array_distinct(F.concat(F.array("q"), strings))
    return x.select(q_id, F.posexplode(all_).alias("pos", "sub_query"))


def reranked(pairs: DataFrame, score: Model | None, query: str, q_text: str, d_text: str, fused: str = "rrf") -> DataFrame:
    """Add ``rank``: by the model's scores of question and passage, by the fused score where there are none."""
    x = replies(pairs, F.concat_ws("\n", q_text, d_text), score, "_score")
    w = Window.partitionBy(query).orderBy(F.coalesce(F.col("_score").try_cast("double"), F.col(fused)).desc(), F.col(d_text))
    return x.withColumn("rank", F.row_number().over(w).cast("long")).drop("_score")


def judged(answers: DataFrame, judges: dict[str, Model], key: str, prompt: Column) -> DataFrame:
    """Rows (key, judge, reply) of each judge on each answer."""
    parts = [replies(answers.select(key, prompt.alias("p")), F.col("p"), m).select(key, F.lit(name).alias("judge"), "reply") for name, m in judges.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def claims(answers: DataFrame, model: Model | None, key: str, text: str) -> DataFrame:
    """Rows (key, claim_no, claim): the reply's non-blank lines without list marks; without a model, the answer's sentences."""
    x = replies(answers.select(key, F.col(text).alias("t")), F.col("t"), model)
    lines = F.when(F.col("reply").isNull(), F.split(F.regexp_replace(F.trim("t"), r"([.!?])\s+", "$1\n"), "\n")).otherwise(F.split("reply", "\n"))
    bare = F.filter(F.transform(lines, lambda s: F.regexp_replace(F.trim(s), r"^([-*•]|[0-9]+[.)])\s+", "")), lambda s: s != "")
    return x.select(key, F.posexplode(bare).alias("claim_no", "claim"))


def verified(found: DataFrame, model: Model | None, claim: str, context: str) -> DataFrame:
    """Add ``verdict``: supported, contradicted or unsupported; unverified without a usable reply."""
    x = replies(found, F.concat_ws("\n", claim, context), model)
    word = F.regexp_extract(F.lower("reply"), r"\b(unsupported|supported|contradicted)\b", 1)
    return x.withColumn("verdict", F.coalesce(F.nullif(word, F.lit("")), F.lit("unverified"))).drop("reply")


def semantic_match(rows: DataFrame, embed: Embed | None, a: str, b: str) -> DataFrame:
    """Add ``match``: cosine of both texts' vectors, cut to 0 to 1, 4 places; null where a text is blank or there is no model."""
    if embed is None:
        return rows.withColumn("match", F.lit(None).cast("double"))
    text = lambda m: (lambda t: [",".join(map(str, v)) for v in m(t)])
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    x = replies(replies(rows, blank(a), text(embed), "_va"), blank(b), text(embed), "_vb")
    u, v = (F.split(c, ",").cast("array<double>") for c in ("_va", "_vb"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
    size = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    match = F.when(size > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(u, v) / size)), 4))
    return x.withColumn("match", match).drop("_va", "_vb")


CHUNKS = 60  # of an answer's chunks so many are held against it
PART = 14_000  # characters of a context that a model reads at once


def _cut(rows: DataFrame, key: list[str], text: str, most: int, gap: int | None) -> DataFrame:
    """Rows (key, part, text): texts as they come, cut at newlines, in one pass that holds a part at a time.

    Neighbours of one key are one context, ``gap`` empty lines between them; each row is its own where ``gap`` is None.
    """
    x = rows.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, no, lines, kinds = None, 0, 0, [], []
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[*key, "part", "text"])

        for part in batches:
            kinds = [*part.schema.types[:-1], pa.int32(), pa.string()]
            for *k, t in zip(*(c.to_pylist() for c in part.columns)):
                more = t.split("\n")
                if gap is None or k != now:
                    if lines:
                        out.append((*now, no, "\n".join(lines)))
                    now, size, no, lines = k, 0, 0, []
                else:
                    more = [""] * gap + more
                for line in more:
                    if lines and size + len(line) > most:
                        out.append((*now, no, "\n".join(lines)))
                        size, no, lines = 0, no + 1, []
                    lines.append(line)
                    size += len(line) + 1
            if out:
                yield batch()
        if lines:
            out.append((*now, no, "\n".join(lines)))
            yield batch()

    return x.mapInArrow(run, ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in key) + ", part int, text string")


def context_parts(contexts: DataFrame, key: list[str], text: str = "text", most: int = PART) -> DataFrame:
    """Rows (key, part, text): a context cut at newlines, each part as many whole lines as come to ``most`` characters.

    A line over ``most`` is a part by itself; nothing is cut off. The time is linear in the text.
    """
    return _cut(contexts, key, text, most, None)


def map_reduced(parts: DataFrame, model: Model | None, key: str, no: str, text: str, most: int = PART) -> DataFrame:
    """Rows (key, narrative, passes, rounds): the model's notes on a question's parts, merged until one is left.

    Each part, in the order of ``no`` and cut at newlines to ``most`` characters, is sent by itself; notes are joined in order,
    cut again and sent again, in a tree whose every call reads ``most`` characters or one line, so that no call holds all notes. ``passes`` counts
    the first cut's parts, ``rounds`` the merges. A part without a reply stands for its own note. It ends when a
    question has one part, or a round doesn't bring its parts down: then those notes are joined as they are.
    """
    spark = parts.sparkSession
    folder = f"{shared_folder(spark)}/narratives-{uuid.uuid4().hex}"

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def joined(rows: DataFrame, order: list[str], text: str, gap: int) -> DataFrame:
        # a question's texts pass one task in their order, without meeting in a row
        return _cut(rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order), [key], text, most, gap)

    cut = put(joined(parts.where(F.col(text).isNotNull()), [no, text], text, 0), "parts-0")
    done: list[DataFrame] = []
    passes, k = cut.groupBy(key).agg(F.count(F.lit(1)).alias("passes")), 0
    while True:
        notes = put(replies(cut, F.col("text"), model, "note").select(key, "part", F.coalesce("note", "text").alias("note")), f"notes-{k}")
        n = notes.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        done.append(notes.join(n.where("n = 1"), key).select(key, F.col("note").alias("narrative"), F.lit(k).cast("long").alias("rounds")))
        rest = notes.join(n.where("n > 1").select(key), key)
        cut = put(joined(rest, ["part"], "note", 1), f"parts-{k + 1}")
        stuck = cut.groupBy(key).agg(F.count(F.lit(1)).alias("m")).join(n, key).where("m >= n").select(key)
        whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "note"))), lambda s: s["note"]), "\n\n")
        done.append(rest.join(stuck, key).groupBy(key).agg(whole.alias("narrative")).select(key, "narrative", F.lit(k).cast("long").alias("rounds")))
        cut = cut.join(stuck, key, "left_anti")
        if not len(cut.take(1)):
            break
        k += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.join(passes, key).select(key, "narrative", "passes", "rounds")


def routed(questions: DataFrame, model: Model | None, prompt: Column) -> DataFrame:
    """Add ``scope`` and ``sections`` from the model's JSON reply; null where it has none, so that signals decide."""
    x = replies(questions, prompt, model)
    r = F.from_json("reply", "scope string, sections array<string>")
    ok = r["scope"].isin("section", "hybrid")
    return x.withColumn("scope", F.when(ok, r["scope"])).withColumn("sections", F.when(ok & (r["scope"] == "section"), r["sections"])).drop("reply")


def relevancy(answers: DataFrame, model: Model | None, question: str, answer: str, threshold: float = 0.5) -> DataFrame:
    """Add ``relevancy``, the number in the model's reply, and whether it reaches ``threshold``; null without one."""
    x = replies(answers, F.concat_ws("\n", question, answer), model, "_rel")
    score = F.regexp_extract("_rel", r"([01](?:\.[0-9]+)?)", 1).try_cast("double")
    return x.withColumn("relevancy", score).withColumn("relevant", F.col("relevancy") >= threshold).drop("_rel")


ANSWER = "document_title string, document_date string, answer string, key_requirements array<string>, source_evidence array<string>, source_passages_used string, confidence_score double"


def answered(questions: DataFrame, model: Model | None, question: str, context: str) -> DataFrame:
    """Add ``reply`` and ``parsed``, the reply's fields, to each question with its context; a question without context is not sent.

    A reply that is no JSON object with an answer and a confidence from 0 to 1 is on record under the title PARSE_ERROR, with
    confidence 0 and the raw reply in its answer. No reply gives no record.
    """
    x = replies(questions, F.when(F.trim(context) != "", F.concat_ws("\n\n", context, question)), model)
    r = F.from_json(F.trim(F.regexp_replace("reply", r"```(?:json)?", "")), ANSWER)
    ok = r["answer"].isNotNull() & r["confidence_score"].between(0.0, 1.0)
    none = F.array().cast("array<string>")
    lost = F.struct(F.lit("PARSE_ERROR").alias("document_title"), F.lit("unknown").alias("document_date"), F.concat(F.lit("The reply is not of the expected form.\n\nRaw output:\n"), F.col("reply")).alias("answer"), none.alias("key_requirements"), none.alias("source_evidence"), F.lit("").alias("source_passages_used"), F.lit(0.0).alias("confidence_score"))
    return x.withColumn("parsed", F.when(F.col("reply").isNull(), None).when(F.coalesce(ok, F.lit(False)), r).otherwise(lost))


EXTRACTION = "title string, answer string, confidence double, groups array<struct<heading:string,items:array<struct<text:string,evidence:string>>>>"


def generative_extraction(questions: DataFrame, model: Model | None, key: str, prompt: Column, view: str, segments: DataFrame | None = None) -> DataFrame:
    """Rows (key, item_id, heading, text, evidence, start, end, doc_start, doc_end, score, grounding) of the items in the model's reply.

    Each quote, or the item's text where it has none, is aligned with its question's ``view``; equal quotes of a question once.
    ``segments`` (key, doc_start, doc_end, view_start) lead a place in the view back to the document. Groups without items go;
    without a usable reply there are no rows. Items are numbered in the reply's order; texts are cut to 600 characters, as they are shown.
    """
    x = replies(questions.select(key, prompt.alias("_p"), F.col(view).alias("_view")), F.col("_p"), model)
    g = x.select(key, "_view", F.posexplode(F.from_json(F.trim(F.regexp_replace("reply", r"```(?:json)?", "")), EXTRACTION)["groups"]).alias("g", "group"))
    i = g.select(key, "_view", "g", F.coalesce("group.heading", F.lit("Findings")).alias("heading"), F.posexplode("group.items").alias("i", "item"))
    quote = F.coalesce(F.nullif("item.evidence", F.lit("")), "item.text", F.lit(""))
    i = i.withColumn("evidence", quote).withColumn("text", F.substring(F.coalesce("item.text", quote), 1, 600))
    found = align_pairs(i.select(key, F.col("evidence").alias("quote"), F.col("_view").alias("text")), [key], least=1)
    order = Window.partitionBy(key).orderBy("g", "i")
    out = i.join(found.withColumnRenamed("quote", "evidence"), [key, "evidence"], "left").withColumn("item_id", F.concat(F.lit("i"), F.lpad((F.row_number().over(order) - 1).cast("string"), 4, "0")))
    out = out.select(key, "item_id", "heading", "text", "evidence", "start", "end", F.coalesce("score", F.lit(0.0)).alias("score"))
    if segments is not None:
        s = segments.select(key, "doc_start", "view_start", (F.col("view_start") + F.col("doc_end") - F.col("doc_start")).alias("_to"))
        at = out.select(key, "item_id", "start", "end").join(s, key).where("view_start <= start and start < _to").groupBy(key, "item_id").agg(F.min(F.struct("view_start", "doc_start")).alias("_s"), F.first("start").alias("_a"), F.first("end").alias("_z"))
        shift = F.col("_s.doc_start") - F.col("_s.view_start")
        out = out.join(at.select(key, "item_id", (F.col("_a") + shift).alias("doc_start"), (F.col("_z") + shift).alias("doc_end")), [key, "item_id"], "left")
    else:
        out = out.withColumn("doc_start", F.lit(None).cast("long")).withColumn("doc_end", F.lit(None).cast("long"))
    return out.select(key, "item_id", "heading", "text", "evidence", "start", "end", "doc_start", "doc_end", "score", grounding_label(F.col("score")).alias("grounding"))


def semantic_utilisation(answers: DataFrame, chunks: DataFrame, key: str, vector: str = "embedding", rank: str = "rnk", most: int = CHUNKS, least: float = 0.30) -> DataFrame:
    """Rows (key, utilisation): of the first ``most`` chunks of each question, the share whose vector's product with the answer's is ``least`` or more.

    ``answers`` has (key, vector), ``chunks`` (key, rank, vector), from a cached table of vectors. Chunks meet their own answer
    alone, by the key. Questions without a vector or without chunks have none.
    """
    first = chunks.where(F.col(vector).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(rank))).where(F.col("_n") <= most)
    x = first.select(key, F.col(vector).alias("_c")).join(answers.where(F.col(vector).isNotNull()).select(key, F.col(vector).alias("_a")), key)
    near = inner_product(F.col("_a"), F.col("_c")) >= least
    return x.groupBy(key).agg(F.round(F.avg(near.cast("double")), 4).alias("utilisation"))


def fallback_sentences(answers: DataFrame, embed: Embed | None, key: str, answer: str, chunk: str) -> DataFrame:
    """Rows (key, sentence, match): the top chunk's sentence most like the answer, the first of equals."""
    parts = F.split(F.regexp_replace(F.trim(chunk), r"([.!?])\s+", "$1\n"), "\n")
    x = semantic_match(answers.select(key, answer, F.posexplode(parts).alias("no", "sentence")), embed, answer, "sentence")
    best = F.max_by(F.struct("sentence", "match"), F.struct(F.coalesce("match", F.lit(-1.0)).alias("m"), -F.col("no")))
    return x.groupBy(key).agg(best.alias("b")).select(key, "b.sentence", "b.match")
