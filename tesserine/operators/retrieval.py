"""Retrieval within a document: dense, BM25 and rank fusion, as joins, groupings and bounded windows.

A group is what is searched as one collection (a document's sentences, say); an item is what is ranked.  Every window is
partitioned by group, and ties go to the smaller item position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.functions.batches import joined, parts
from tesserine.operators import blocks as BL

# Fixed values
TOP_SENTENCES = TOP_ENTRIES = 5
RRF_K = 60
TECHNIQUES = ("sem_rag", "denso", "hibrido")
THEME_QUERY = "objetivo da pesquisa, tema central e objeto de estudo"
METHOD_QUERY = "procedimentos metodológicos da pesquisa: tipo de estudo, abordagem, participantes, coleta de dados, instrumentos e análise dos dados"
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Entries of a knowledge base at most; a larger one is no base to send along with every task.
MOST_ENTRIES = 10_000
#: Weights of a query's tokens in all groups at most that are sent along.
MOST_WEIGHTS = 200_000
#: Words whose directions the encoder of hashed words keeps at a time.
KEPT_WORDS = 8_192


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from the first coordinate on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def hashed_encoder(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a sentence encoder: hashed words on random directions, length 1, float32."""

    def encode(texts: list[str]) -> np.ndarray:
        out, known = np.zeros((len(texts), size), np.float32), {}
        for i, text in enumerate(texts):
            for word in text.lower().split():
                direction = known.get(word)
                if direction is None:
                    seed = hashlib.blake2b(word.encode(), digest_size=8).digest()
                    direction = np.random.default_rng(int.from_bytes(seed, "little")).normal(size=size).astype(np.float32)
                    if len(known) < KEPT_WORDS:
                        known[word] = direction
                out[i] += direction
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)

    return encode


def embedded(text: Column, kind: str, encoder: Callable[[list[str]], np.ndarray] | None = None) -> Column:
    """Vectors of texts, with the prefix the encoder was trained with: ``query`` or ``passage``."""
    make = encoder or hashed_encoder()

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        return vectors_of(texts, kind, make)

    return vectors(text)


def vectors_of(texts: pa.Array, kind: str, make: Callable[[list[str]], np.ndarray]) -> pa.Array:
    """``embedded`` of an array of texts; the encoder gets a part of them at a time."""
    return joined([listed(make([f"{kind}: {t or ''}" for t in part])) for part in parts(texts)], pa.list_(pa.float32()))


def listed(vectors: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists of floats."""
    vectors = np.asarray(vectors, np.float32)
    ends = np.arange(len(vectors) + 1) * vectors.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(vectors.reshape(-1)))


def top(rows: DataFrame, group: str | list[str], score: str, position: str, k: int) -> DataFrame:
    """The ``k`` best of each group with their ``rank``; ties go to the smaller position."""
    groups = [group] if isinstance(group, str) else group
    place = Window.partitionBy(*groups).orderBy(F.desc(score), F.asc(position))
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, rows: DataFrame, by: str, k: int) -> DataFrame:
    """``query_id, vec_id, s``: of each query (``query_id, by, __q``) and each block of the rows (``vec_id, by, embedding``) of its
    ``by`` the ``k`` nearest others, ties to the smaller id, so that ``top`` finds among them the k best of all."""

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v = (np.asarray(t.column(n).combine_chunks(), dtype=np.int64) for t, n in ((left, "query_id"), (right, "vec_id")))
        (a, asked), (b, there) = BL.matrix(left.column("__q")), BL.matrix(right.column("embedding"))
        order = np.argsort(v, kind="stable")
        v, there, columns = v[order], there[order], np.ascontiguousarray(b[order].T)
        found = []
        for at in range(0, len(q), BL.TILE):
            s = np.concatenate([BL.products(a[at : at + BL.TILE], columns[:, c : c + 8 * BL.TILE]) for c in range(0, len(v), 8 * BL.TILE)], axis=1)
            for r in range(len(s)):
                row, known = np.where(there & asked[at + r], s[r], -np.inf), np.nonzero(v != q[at + r])[0]
                # a stable sort keeps the smaller ids of equal products first; NaN counts as the largest, as in Spark
                values = np.where(np.isnan(row[known]), np.inf, row[known])
                if len(known) > k:
                    last = np.partition(values, len(values) - k)[len(values) - k]
                    known, values = known[values >= last], values[values >= last]
                best = known[np.argsort(-values, kind="stable")[:k]]
                found.append((np.full(len(best), q[at + r]), v[best], row[best]))
        query, vec, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.array([], t) for t in ("i8", "i8", "f8"))
        return pa.table({"query_id": query, "vec_id": vec, "s": pa.array(score, mask=np.isneginf(score))})

    left = queries.withColumn("query_id", F.col("query_id").cast("long"))
    return BL.met(left, rows.withColumn("vec_id", F.col("vec_id").cast("long")), by, F.col("query_id"), F.col("vec_id"), pair, "query_id long, vec_id long, s double")


def ranks(rows: DataFrame, group: str, score: str, position: str, positive: bool = False) -> DataFrame:
    """``group, position, rank``, of positive scores alone where asked."""
    rows = rows.where(F.col(score) > 0) if positive else rows
    place = Window.partitionBy(group).orderBy(F.desc(score), F.asc(position))
    return rows.select(group, position, F.row_number().over(place).alias("rank"))


def fused(first: DataFrame, second: DataFrame, group: str, position: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rank lists: ``group, position, score``; a list an item isn't in adds nothing."""
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    both = first.withColumnRenamed("rank", "__a").join(second.withColumnRenamed("rank", "__b"), [group, position], "full")
    return both.select(group, position, (share("__a") + share("__b")).alias("score"))


def fused_best(first: DataFrame, second: DataFrame, group: str, position: str, n: int, k: int = RRF_K) -> DataFrame:
    """``group, position, score, rank``: the ``n`` best of ``top`` over ``fused``, without ranking all of a group in one task.

    The lists have ``group, position, score``, positions once a group; a row with a null is in none.  An
    item outside the first ``k + 2n`` of both lists has less than 1 / (k + n), which the first n of either list reach, so the
    heads of the lists hold all of the result.  Their ranks are then counted: each item of a list falls between two of the
    at most 2k + 4n candidates of its group, and the numbers of items that fall there, which are added up before they are
    shuffled, give the candidates' ranks.  Heads are cut in each partition before a group's come together.
    """
    depth = k + 2 * n
    at = F.struct((-F.col("score")).alias("s"), F.col(position).alias("p"))
    # one filter for all uses of a list, so that its shuffled form is made once; joins would add the first two to some of them
    lists = [rows.select(group, position, "score").where(" AND ".join(f"`{c}` IS NOT NULL" for c in (group, position, "score"))).where(~F.isnan("score")) for rows in (first, second)]
    heads = [top(rows, group, "score", position, depth).select(group, position) for rows in lists]
    placed = chosen = heads[0].unionByName(heads[1]).distinct()
    score = F.lit(0.0)
    for name, listed in zip(("__a", "__b"), lists, strict=True):
        edges = listed.join(chosen, [group, position]).groupBy(group).agg(F.array_sort(F.collect_list(at)).alias("__edges"))
        fallen = listed.select(group, at.alias("__item")).join(edges, group).select(group, edges_before("__edges", "__item", 2 * depth).alias("__at"))
        counts = fallen.groupBy(group, "__at").agg(F.count(F.lit(1)).alias("__n"))
        reached = counts.select(group, "__at", F.sum("__n").over(Window.partitionBy(group).orderBy("__at")).alias(name))
        named = edges.select(group, F.posexplode("__edges").alias("__at", "e")).select(group, "__at", F.col("e.p").alias(position))
        placed = placed.join(named.join(reached, [group, "__at"]).drop("__at"), [group, position], "left")
        score = score + F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(name)), F.lit(0.0))
    return top(placed.select(group, position, score.alias("score")), group, "score", position, n)


def edges_before(edges: str, item: str, most: int) -> Column:
    """How many of the sorted ``edges`` (``most`` of them at most) come before ``item``, found by halves."""
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(most.bit_length()))))
    # beyond the end an edge is null, and not before anything
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(F.col(edges), low + step - 1) < F.col(item), low + step).otherwise(low))


def bm25(items: DataFrame, query: DataFrame, group: str, item: str, groups: int | None = None) -> DataFrame:
    """BM25-Okapi: ``group, item, score`` of every item.

    ``items`` has ``group, item, tokens array<string>``; an item without tokens counts as one of a token of its own.  ``query``
    has one row a query token, repeated ones counting again, of a group (``group, token``) or of all groups (``token``).  A
    negative idf becomes EPSILON times the mean idf of the group.  Texts are read twice: for the counts of a group, in which
    an item gives each of its tokens once, and for the scores, in which only tokens of the query leave their item.  Where the
    number of ``groups`` is told and few weights can come of it, they are sent along, and no token is shuffled for its weight.
    """
    by = [group, "token"] if group in query.columns else ["token"]
    tokens = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("_")))
    items = items.select(group, item, tokens.alias("tokens")).withColumn("dl", F.size("tokens"))
    # the empty token stands for the item itself
    once = items.select(group, "dl", F.explode(F.array_append(F.array_distinct("tokens"), F.lit(""))).alias("token"))
    counts = once.groupBy(group, "token").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("total"))
    wanted = query.groupBy(*by).agg(F.count(F.lit(1)).alias("qtf"))
    weights = token_weights(counts, wanted, by, group)
    if groups is not None and groups * wanted.count() <= MOST_WEIGHTS:
        weights = F.broadcast(weights)
    every = items.select(group, item, "dl", F.explode(F.array_append("tokens", F.lit(""))).alias("token"))
    hits = every.join(weights, [group, "token"], "left").where("token = '' OR weight IS NOT NULL")
    tf = hits.groupBy(group, item, "token").agg(F.count(F.lit(1)).alias("tf"), *(F.max(c).alias(c) for c in ("dl", "avgdl", "weight")))
    gain = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.groupBy(group, item).agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("score"))


def token_weights(counts: DataFrame, wanted: DataFrame, by: list[str], group: str) -> DataFrame:
    """``group, token, avgdl, weight`` of the ``wanted`` tokens (``by, qtf``) that a group has.

    ``counts`` (``group, token, df, total``) is used once, as what it stems from would be read again for each use: tokens of
    one ``df`` have one idf, so a group becomes a row with an entry for each ``df`` that its tokens have.
    """
    of_item = F.col("token") == ""
    asked = F.when(F.col("qtf").isNotNull() & ~of_item, F.struct("token", "qtf"))
    alike = counts.join(wanted, by, "left").groupBy(group, "df").agg(
        F.count(F.when(~of_item, 1)).alias("tokens"),
        F.max(F.when(of_item, F.col("total"))).alias("total"),
        F.collect_list(asked).alias("asked"),
    )
    n = F.when(F.col("total").isNotNull(), F.col("df"))
    whole = alike.groupBy(group).agg(F.max(n).alias("n"), F.max("total").alias("total"), F.collect_list(F.struct("df", "tokens", "asked")).alias("all"))
    idf = lambda df: F.log(F.col("n") - df + 0.5) - F.log(df + 0.5)
    rows = F.transform("all", lambda x: F.struct(x["tokens"].alias("tokens"), x["asked"].alias("asked"), idf(x["df"]).alias("idf")))
    whole = whole.select(group, (F.col("total") / F.col("n")).alias("avgdl"), rows.alias("all"))
    total = lambda value: F.aggregate("all", F.lit(0.0), lambda s, x: s + value(x))
    # a group has items, and an item has a token
    mean = total(lambda x: F.when(x["tokens"] > 0, x["tokens"] * x["idf"]).otherwise(0.0)) / total(lambda x: x["tokens"].cast("double"))
    each = whole.select(group, "avgdl", mean.alias("mean_idf"), F.explode("all").alias("x")).select(group, "avgdl", "mean_idf", F.col("x.idf").alias("idf"), F.explode("x.asked").alias("w"))
    return each.select(group, F.col("w.token").alias("token"), "avgdl", (F.col("w.qtf") * F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf"))).alias("weight"))


def sent_along(entries: DataFrame) -> DataFrame:
    """A knowledge base as the broadcast side of a join, once it is known to be no larger than one should be."""
    n = entries.limit(MOST_ENTRIES + 1).count()
    return F.broadcast(entries) if n <= MOST_ENTRIES else entries


def dense_scores(sentences: DataFrame, titles: DataFrame, theme: list[float], method: list[float], key: str) -> DataFrame:
    """``theme_score`` (mean of the fixed query and the own title) and ``method_score`` of each sentence (``vector``)."""
    lit = lambda v: F.array(*map(F.lit, v))
    rows = sentences.join(titles.select(key, F.col("vector").alias("__title")), key)
    return rows.withColumns({
        "theme_score": (dot(F.col("vector"), lit(theme)) + dot(F.col("vector"), F.col("__title"))) / 2,
        "method_score": dot(F.col("vector"), lit(method)),
    }).drop("__title")


def entry_similarity(chosen: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """``key, ord, score``: each entry's greatest similarity to one of the chosen sentences; ``entries`` have ``ord, vector``."""
    pairs = chosen.select(key, F.col("vector").alias("__s")).join(sent_along(entries.select("ord", F.col("vector").alias("__e"))), F.lit(True))
    return pairs.groupBy(key, "ord").agg(F.max(dot(F.col("__s"), F.col("__e"))).alias("score"))


def literal_hits(chosen: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """``key, ord, score``: points of each entry for expressions in the chosen sentences, read in order of their rank.

    A term or synonym counts 2, a sign 1; each listed expression counts, even where two fold to the same form.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "texto")))
    texts = chosen.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["texto"]), " ").alias("__t"))
    texts = texts.select(key, T.expression(F.col("__t")).alias("__t"))
    marked = entries.select("ord", F.explode(F.concat(
        F.transform(F.concat(F.array("termo"), "sinonimos"), lambda e: F.struct(e.alias("e"), F.lit(2).alias("w"))),
        F.transform("sinais", lambda e: F.struct(e.alias("e"), F.lit(1).alias("w"))),
    )).alias("x"))
    first_word = lambda e: F.substring_index(e, " ", 1)
    marked = marked.select("ord", T.expression(F.col("x.e")).alias("__e"), F.col("x.w").alias("__w")).withColumn("__first", first_word(F.col("__e")))
    # a text and an expression meet on the expression's first word, so a base of any size needs no pairing of all with all
    spoken = texts.select(key, "__t", F.explode(F.array_distinct(F.split("__t", " "))).alias("__first"))
    found = spoken.join(marked, "__first").where(T.contains_expression(F.col("__t"), F.col("__e")))
    return found.groupBy(key, "ord").agg(F.sum("__w").cast("double").alias("score"))


def without_retrieval(sentences: DataFrame, key: str) -> DataFrame:
    """All sentences, score 1, in their order."""
    return sentences.withColumns({"rank": F.col("pos"), "score": F.lit(1.0)})


def contexts(
    docs: DataFrame,
    sentences: DataFrame,
    entries: DataFrame,
    technique: str,
    encoder: Callable[[list[str]], np.ndarray] | None = None,
    key: str = "id",
    k: int = TOP_SENTENCES,
    k_entries: int = TOP_ENTRIES,
) -> DataFrame:
    """``key, tecnica, frases_tematicas, frases_metodologia, verbetes`` of each document.

    ``docs`` has ``titulo`` and ``palavras_chave``; ``sentences`` has ``pos, frase_id, texto`` and, if they are at hand,
    ``vector``; ``entries`` has ``ord, id, termo, eixo, definicao, sinais, sinonimos`` and maybe ``vector``.
    """
    if technique not in TECHNIQUES:
        raise ValueError(f"unknown technique {technique!r}; there are {', '.join(TECHNIQUES)}")
    if technique == "sem_rag":
        whole = packed(without_retrieval(sentences, key), key, "frases_tematicas")
        return whole.select(key, F.lit(technique).alias("tecnica"), "frases_tematicas", F.col("frases_tematicas").alias("frases_metodologia"), F.array().cast("array<string>").alias("verbetes"))
    make = encoder or hashed_encoder()
    # dealt anew, by all that is read of them, so that they are made once for all their uses, and no task holds one process to make
    # them and another one to embed them; those of no document meet no title
    sentences = sentences.where(F.col(key).isNotNull()).repartition(key, "pos", "frase_id", "texto")
    if "vector" not in sentences.columns:
        sentences = sentences.withColumn("vector", embedded(F.col("texto"), "passage", make))
    if "vector" not in entries.columns:
        entries = entries.withColumn("vector", embedded(T.entry_text(F.col("termo"), F.col("sinonimos")), "passage", make))
    titles = docs.select(key, embedded(F.col("titulo"), "query", make).alias("vector"))
    theme, method = make([f"query: {THEME_QUERY}", f"query: {METHOD_QUERY}"]).astype(float).tolist()
    scored = dense_scores(sentences, titles, theme, method, key)
    if technique == "hibrido":
        tokens = sentences.select(key, "pos", T.retrieval_tokens(F.col("texto")).alias("tokens"))
        own = docs.select(key, F.explode(T.retrieval_tokens(F.concat_ws(" ", "titulo", F.array_join("palavras_chave", " ")))).alias("token"))
        base = entries.select(F.explode(F.concat(F.array("termo"), "sinonimos", "sinais")).alias("e")).select(F.explode(T.retrieval_tokens(F.col("e"))).alias("token")).distinct()
        for name, query in (("theme", own), ("method", base)):
            scored = scored.join(bm25(tokens, query, key, "pos").withColumnRenamed("score", f"{name}_words"), [key, "pos"], "left")
        scored = scored.withColumns({f"{name}_score": fused_in_place(f"{name}_score", f"{name}_words", key, "pos") for name in ("theme", "method")})
    place = lambda c: F.row_number().over(Window.partitionBy(key).orderBy(F.desc(c), F.asc("pos")))
    chosen = scored.withColumns({"theme_rank": place("theme_score"), "method_rank": place("method_score")}).where((F.col("theme_rank") <= k) | (F.col("method_rank") <= k))
    # a document's chosen sentences as one row, whole, so that all their uses have one plan and vectors are made once
    whole = F.struct("theme_rank", "method_rank", "theme_score", "method_score", "frase_id", "texto", "vector")
    chosen = chosen.groupBy(key).agg(F.collect_list(whole).alias("__chosen")).select(key, F.explode("__chosen").alias("__c")).select(key, "__c.*")
    methods = chosen.where(F.col("method_rank") <= k).withColumnRenamed("method_rank", "rank")
    near = entry_similarity(methods, entries, key)
    if technique == "hibrido":
        # every entry has a similarity, so the entries with points are among them
        points = literal_hits(methods, entries, key).withColumnRenamed("score", "points")
        near = near.join(points, [key, "ord"], "left").select(key, "ord", fused_in_place("score", "points", key, "ord").alias("score"))
    best = top(near, key, "score", "ord", k_entries).join(sent_along(entries.select("ord", "id")).withColumnRenamed("id", "__id"), "ord")
    listed = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "__id"))).alias("v")).select(key, F.transform("v", lambda v: v["__id"]).alias("verbetes"))
    found = chosen.groupBy(key).agg(*(in_order(f"{n}_rank", f"{n}_score", k).alias(c) for n, c in (("theme", "frases_tematicas"), ("method", "frases_metodologia"))))
    return found.join(listed, key, "left").select(key, F.lit(technique).alias("tecnica"), "frases_tematicas", "frases_metodologia", F.coalesce("verbetes", F.array().cast("array<string>")).alias("verbetes"))


def fused_in_place(first: str, second: str, group: str, position: str, k: int = RRF_K) -> Column:
    """``fused`` of two scores of one row: every row has the first, those with a positive second one get its share too.

    Positive scores stand first in their order, so the ranks are those of ``ranks``, and one sorted shuffle by group gives both.
    """
    share = lambda c: F.lit(1.0) / (F.lit(float(k)) + F.row_number().over(Window.partitionBy(group).orderBy(F.desc(c), F.asc(position))))
    return share(first) + F.when(F.col(second) > 0, share(second)).otherwise(0.0)


def in_order(rank: str, score: str, k: int) -> Column:
    """The sentences of rank ``k`` and better as one array; scores rounded to 4 digits for output alone."""
    rows = F.array_sort(F.collect_list(F.when(F.col(rank) <= k, F.struct(F.col(rank).alias("rank"), "frase_id", "texto", F.bround(score, 4).alias("score")))))
    return F.transform(rows, lambda r: F.struct(r["frase_id"].alias("frase_id"), r["texto"].alias("texto"), r["score"].alias("score")))


def packed(ranked: DataFrame, key: str, name: str) -> DataFrame:
    """All ranked sentences of a document as one array."""
    return ranked.groupBy(key).agg(in_order("rank", "score", 2**31 - 1).alias(name))
