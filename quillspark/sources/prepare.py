"""From raw question sets to (queries, corpus): projections and joins over their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import seeded_hash
from ..functions.text import chunks, collapse, entity_of, let, safe_id, weak_label, with_choices
from ..storage import materialize


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the last by ``order``."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r")).select(key, "r.*")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r")).select(key, "r.*")


def annotated_queries(annotations: DataFrame, entities: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations (data_id, image_id, question, answer, answer_eval, data_split) with their entity (data_id, entity_id,
    entity_text, line; the last line of a data_id counts) and image file (stem, path; the first path of a stem)."""
    kb = last_per_key(entities, "data_id", "line").drop("line")
    files = first_per_key(images.withColumn("_p", F.col("path")), "stem", "_p").select(F.col("stem").alias("image_id"), F.col("path").alias("image_path"))
    empty = F.array().cast("array<string>")
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    gold = F.coalesce(some("answer_eval"), some("answer"), empty)
    rows = annotations.join(kb, "data_id", "left").join(files, "image_id", "left")
    meta = F.struct("image_id", F.coalesce("data_split", F.lit("")).alias("data_split"), "entity_id", "entity_text")
    return rows.select(F.col("data_id").alias("query_id"), "question", gold.alias("gold_answers"), "image_path", meta.alias("metadata"))


def page_chunks(pages: DataFrame, wanted: DataFrame, most: int = 1200) -> DataFrame:
    """Chunks ``<entity>_p<i>`` of the wanted entities' pages (entity_id, title, text) that have a text."""
    kept = pages.join(wanted.select("entity_id").distinct(), "entity_id", "left_semi").where(F.coalesce("text", F.lit("")) != "")
    rows = kept.select("entity_id", "title", F.posexplode(chunks(F.col("text"), most)).alias("i", "text"))
    return rows.select(F.concat("entity_id", F.lit("_p"), F.col("i").cast("string")).alias("doc_id"), "title", "text")


def pages_to_fetch(entities: DataFrame, pages: DataFrame, titles: DataFrame) -> DataFrame:
    """Entities (entity_id, entity_text) whose page has no text yet, with the title to ask for: the known one, else their text."""
    done = pages.where(F.coalesce("text", F.lit("")) != "").select("entity_id").distinct()
    todo = entities.join(done, "entity_id", "left_anti").join(titles.withColumnRenamed("title", "_t"), "entity_id", "left")
    return todo.select("entity_id", F.coalesce(F.nullif("_t", F.lit("")), "entity_text").alias("title"))


def entity_image_urls(records: DataFrame, needed: DataFrame, cached: DataFrame) -> DataFrame:
    """entity_id, title, image_url of the needed entities: as cached (the last line of an entity), else from the big scan of
    records (wikidata_id, wikipedia_title, wikipedia_image_url, line; the first). Those found nowhere are left out."""
    have = last_per_key(cached.select("entity_id", "title", "image_url", "line"), "entity_id", "line").drop("line")
    known = have.join(needed.select("entity_id").distinct(), "entity_id", "left_semi")
    todo = needed.select("entity_id").distinct().join(have.select("entity_id"), "entity_id", "left_anti")
    raw = records.select(F.col("wikidata_id").alias("entity_id"), F.col("wikipedia_title").alias("title"), F.col("wikipedia_image_url").alias("image_url"), "line")
    fresh = first_per_key(raw.join(todo, "entity_id", "left_semi"), "entity_id", "line").drop("line")
    return known.unionByName(fresh)


def attached_images(corpus: DataFrame, images: DataFrame) -> DataFrame:
    """Corpus chunks with their entity's downloaded image (entity_id, image_path), where there is one."""
    files = images.select(F.col("entity_id").alias("_e"), F.col("image_path").alias("_i"))
    own = F.coalesce("_i", "image_path") if "image_path" in corpus.columns else F.col("_i")
    rest = [c for c in corpus.columns if c not in ("image_path", "entity_id")]
    return corpus.withColumn("_key", entity_of(F.col("doc_id"))).join(files, F.col("_key") == F.col("_e"), "left").select(*rest, own.alias("image_path"), F.col("_key").alias("entity_id"))


def image_manifest(targets: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets (image_id, source_path) that are present (image_id, path), and the ids of the missing."""
    marked = targets.join(present, "image_id", "left")
    return marked.where("path is not null"), marked.where("path is null").select("image_id")


def image_stem(entity_id: Column, title: Column) -> Column:
    return safe_id(F.concat_ws("_", entity_id, F.coalesce(F.nullif(title, F.lit("")), entity_id)))


def choice_questions(splits: dict[str, DataFrame], prefix: str) -> tuple[DataFrame, DataFrame]:
    """Picture questions with choices, splits one after the other: (pid, image, question, choices, answer, hint, lecture, subject, topic).

    Rows without an image are left out; the rest is numbered in order of split and pid. Golds: the answer, its letter,
    both. Two documents a row: the lecture (else hint, else question) and the hint (else a constant).
    """
    parts = [df.select("*", F.lit(name).alias("split"), F.lit(i).alias("_s")) for i, (name, df) in enumerate(splits.items())]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    rows = numbered(whole.where(F.length("image") > 0), ["_s", "pid"], "index")
    letter = F.char(F.col("answer") + 65)
    text = F.element_at("choices", F.col("answer") + 1)
    asked = with_choices(F.col("question"), F.col("choices"))
    name = F.concat(F.lit(f"{prefix}-"), F.col("index").cast("string"))
    queries = rows.select(
        F.concat(F.lit(f"{prefix}-smoke-"), F.col("index").cast("string")).alias("query_id"), asked.alias("question"),
        F.array(text, letter, F.concat(letter, F.lit(". "), text)).alias("gold_answers"), F.struct("subject", "topic", "split", "pid").alias("metadata"),
    )
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    n = (F.col("index") + 1).cast("string")
    lecture = F.struct(F.concat(name, F.lit("-lecture")).alias("doc_id"), F.concat(F.lit("Science lesson "), n).alias("title"), F.coalesce(said("lecture"), said("hint"), asked).alias("text"))
    hint = F.struct(F.concat(name, F.lit("-hint")).alias("doc_id"), F.concat(F.lit("Question context "), n).alias("title"), F.coalesce(said("hint"), F.lit("Use the pictured scientific evidence.")).alias("text"))
    return queries, rows.select(F.explode(F.array(lecture, hint)).alias("d")).select("d.*")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 0 in a total order: counts of range partitions, then places inside them, so no task holds all rows."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    held = materialize(sorted_, "numbered")
    sizes = held.groupBy("_part").agg(F.count("*").alias("_c"))
    before = sizes.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return held.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_before", "_place")


def unseen_images(corpus: DataFrame, query_images: DataFrame) -> DataFrame:
    """Corpus images (name, content) that are no query's image, by size and digest; names of inputs are left out. Adds a
    label from the name and the text of a document."""
    mark = lambda df: df.withColumn("_size", F.length("content")).withColumn("_sum", F.sha2("content", 256))
    fresh = mark(corpus).where(~F.contains(F.lower("name"), F.lit("_input."))).join(mark(query_images).select("_size", "_sum").distinct(), ["_size", "_sum"], "left_anti")
    label = weak_label(F.regexp_replace("name", r"\.[^.]*$", ""))
    return fresh.select("name", label.alias("label"), F.concat(F.lit("Image filename weak label: "), label, F.lit(". Original filename: "), F.col("name"), F.lit(".")).alias("text"))


def visual_questions(rows: DataFrame, n: int) -> DataFrame:
    """Queries of the first n (by id) picture questions with four choices: (id, question, choices, answer, answer_choice,
    image_path, scenario, aspect). Golds: the answer, its letter, both. Fewer than n raise ValueError."""
    some = rows.orderBy("id").limit(n)
    if (have := some.count()) < n:
        raise ValueError(f"{have} questions of {n}")
    return some.select(
        F.concat(F.lit("mrag-"), F.col("id").cast("string")).alias("query_id"), with_choices(F.col("question"), F.col("choices")).alias("question"),
        F.array("answer", "answer_choice", F.concat("answer_choice", F.lit(". "), "answer")).alias("gold_answers"), "image_path", F.struct("scenario", "aspect").alias("metadata"),
    )


def type_histogram(questions: DataFrame, column: str) -> DataFrame:
    """How often each value of a column occurs; nulls are a value."""
    return questions.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def entity_documents(images: DataFrame) -> DataFrame:
    """One document per entity of annotated images (image_id, entities, qids, caption): the first title, captions distinct in
    order of image. Images without ids stand for themselves."""
    ids = F.when(F.size("qids") > 0, F.col("qids")).otherwise(F.array(F.concat(F.lit("kvqa-image-"), F.col("image_id"))))
    names = F.when(F.size("entities") > 0, F.col("entities")).otherwise(F.transform(ids, lambda q: F.lit("")))
    rows = images.select("image_id", collapse(F.col("caption")).alias("caption"), F.posexplode(F.slice(F.arrays_zip(ids.alias("qid"), names.alias("name")), F.lit(1), F.least(F.size(ids), F.size(names)))).alias("pos", "z"))
    rows = rows.select(F.col("z.qid").alias("doc_id"), F.col("z.name").alias("name"), "caption", F.struct("image_id", "pos").alias("at"))
    docs = rows.groupBy("doc_id").agg(F.min_by("name", "at").alias("name"), F.array_sort(F.collect_list(F.struct("at", "caption"))).alias("c"))
    title = F.coalesce(F.nullif("name", F.lit("")), "doc_id")
    told = F.array_distinct(F.filter(F.transform("c", lambda x: x["caption"]), lambda t: t != ""))
    text = F.concat_ws(" ", F.concat(F.lit("Entity name: "), title, F.lit(".")), F.when(F.size(told) > 0, F.concat(F.lit("Wiki caption: "), F.array_join(told, " "))), F.concat(F.lit("Wikidata QID: "), F.col("doc_id"), F.lit(".")))
    return docs.select("doc_id", title.alias("title"), text.alias("text"))


def paired_questions(images: DataFrame) -> DataFrame:
    """A query for each question with an answer of annotated images (image_id, questions, answers, types): ids by place."""
    n = F.least(F.size("questions"), F.size("answers"))
    rows = images.select("image_id", "types", F.posexplode(F.slice(F.arrays_zip("questions", "answers"), F.lit(1), n)).alias("i", "z"))
    kind = F.try_element_at("types", F.col("i") + 1)
    return rows.select(F.concat(F.lit("kvqa-"), "image_id", F.lit("-"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("query_id"), F.col("z.questions").alias("question"), F.array("z.answers").alias("gold_answers"), kind.alias("type"))


def scene_text(objects: Column, most: int = 80) -> Column:
    """Sentences for a scene graph: array of (id, name, attributes, relations of (name, object)); at most ``most`` objects,
    8 attributes and 8 relations each. A relation to an unknown object names its id."""
    kept = F.slice(objects, 1, most)
    clean = F.transform(kept, lambda o: F.struct(o["id"].alias("id"), collapse(o["name"]).alias("name"), F.slice(F.filter(F.transform(o["attributes"], collapse), lambda a: a != ""), 1, 8).alias("attributes"), F.slice(o["relations"], 1, 8).alias("relations")))

    def said(all_: Column) -> Column:
        plain = F.transform(all_, lambda o: F.concat(o["name"], F.when(F.size(o["attributes"]) > 0, F.concat(F.lit(" with attributes "), F.array_join(o["attributes"], ", "))).otherwise(""), F.lit(".")))
        ties = F.flatten(F.transform(all_, lambda o: F.transform(F.filter(o["relations"], lambda r: (collapse(r["name"]) != "") & (r["object"] != "")), lambda r: F.concat(o["name"], F.lit(" "), collapse(r["name"]), F.lit(" "), F.coalesce(F.try_element_at(F.transform(F.filter(all_, lambda x: x["id"] == r["object"]), lambda x: x["name"]), F.lit(1)), r["object"]), F.lit(".")))))
        return F.array_join(F.concat(plain, ties), " ")

    return let(clean, said)


def program_text(steps: Column, raw: Column, types: Column) -> Column:
    """A question's program (array of (operation, argument)) as text, else its raw form; then its types (map)."""
    parts = F.filter(F.transform(steps, lambda s: F.concat_ws(": ", F.nullif(collapse(s["operation"]), F.lit("")), F.nullif(collapse(s["argument"]), F.lit("")))), lambda t: t != "")
    first = F.when(F.size(parts) > 0, parts).when(collapse(raw) != "", F.array(collapse(raw))).otherwise(F.array().cast("array<string>"))
    told = F.array_join(F.transform(F.filter(F.map_entries(types), lambda e: e["value"].isNotNull()), lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    return F.array_join(F.concat(first, F.when(F.coalesce(told, F.lit("")) != "", F.array(F.concat(F.lit("question_type: "), told))).otherwise(F.array().cast("array<string>"))), ". ")


def image_corpus(questions: DataFrame, scenes: DataFrame) -> DataFrame:
    """A document per image of questions (image_id, question_id, program): its scene (image_id, scene), else the programs of
    its questions in order of id, else a constant."""
    per = questions.groupBy("image_id").agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("question_id", "program"))), lambda x: x["program"]), lambda t: t != ""), " ").alias("programs"), F.count("*").alias("questions"))
    rows = per.join(scenes, "image_id", "left")
    has = F.coalesce(F.col("scene"), F.lit("")) != ""
    text = F.when(has, F.col("scene")).when(F.col("programs") != "", F.col("programs")).otherwise("Visual scene without a description.")
    return rows.select("image_id", text.alias("text"), "questions", has.alias("has_scene"))


def golds(answer: Column, full: Column) -> Column:
    """The answer, and the full answer where it says something else."""
    f = F.coalesce(F.nullif(full, F.lit("")), answer)
    return F.when(f != answer, F.array(answer, f)).otherwise(F.array(answer))


def chosen_instructions(rows: DataFrame, n: int, seed: int = 0, complete: bool = False) -> DataFrame:
    """n distinct questions (id, imageId) in the order of a seeded hash; those without an id or image are left out.

    With ``complete`` fewer than n raise ValueError."""
    whole = rows.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("imageId", F.lit("")) != "")).dropDuplicates(["id"])
    found = whole.orderBy(seeded_hash(F.lit(seed), F.col("id")), "id").limit(n)
    if complete and (have := found.count()) < n:
        raise ValueError(f"{have} questions of {n}")
    return found


def wanted_images(images: DataFrame, wanted: DataFrame, complete: bool = False) -> DataFrame:
    """Of the wanted ids each image once: the first (by source) that has bytes.

    With ``complete`` ids without any raise ValueError, which names some of them."""
    ids = wanted.select("image_id").distinct()
    found = first_per_key(images.where(F.length("content") > 0).join(ids, "image_id", "left_semi"), "image_id", "source")
    if complete:
        missing = ids.join(found.select("image_id"), "image_id", "left_anti")
        if some := [r["image_id"] for r in missing.orderBy("image_id").limit(5).collect()]:
            raise ValueError(f"{missing.count()} images are missing, such as {some}")
    return found


def answer_statistics(questions: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent answers (a report of the top ones), ties by answer."""
    return questions.groupBy("answer").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "answer").limit(top)
