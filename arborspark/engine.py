"""The library in one place: build an index of Markdown documents, find passages, retrieve evidence.

``Engine`` binds scorers and limits. Scorers are column expressions by default; a learned
one goes in as a function on DataFrames (:mod:`arborspark.operators.models`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborspark.functions.text import jaccard, token_set
from arborspark.operators import checks, fusion, lexical, markdown, packet, segment, select, tree, walk
from arborspark.sources.work import written


@dataclass(frozen=True)
class Policy:
    """How a retrieval searches and what it hands on."""

    search: walk.Limits = field(default_factory=lambda: walk.Limits(beam=5, acceptance=0.01, extra=0.25))
    dense: int = 64
    pairwise: int = 30
    agreement: float = 0.5
    shared: int = 12
    output: int = 5
    allowance: int = 6000

    def __post_init__(self) -> None:
        if min(self.dense, self.pairwise, self.shared, self.output) < 1 or not 0.5 <= self.agreement <= 1:
            raise ValueError(f"{self} asks for nothing, or for less than a majority")


def overlap(text: Column, need: Column) -> Column:
    return F.round(jaccard(token_set(text), token_set(need)), 6)


@dataclass(frozen=True)
class Engine:
    """``score(text, need)`` routes and selects, ``prefer(a, b)`` compares two cards (structs with ``text`` and ``question``)."""

    policy: Policy = field(default_factory=Policy)
    score: Callable[[Column, Column], Column] = overlap
    prefer: Callable[[Column, Column], Column] | None = None
    prior: float = 0.95

    def build(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(units, nodes)`` of documents (``doc_id, text``): paragraphs with their headings, and the content tree."""
        found = written(markdown.with_text(markdown.blocks(docs), docs))
        units = markdown.units(found)
        units = units.join(found.select("doc_id", "start", "text"), ["doc_id", "start"])
        topics = lambda u: segment.groups(u, segment.anchor_drop(u, self.prior))
        return written(units), written(markdown.index(docs, topics, found))

    def find(self, docs: DataFrame, nodes: DataFrame, questions: DataFrame, scope: DataFrame | None = None, limit: int = 64, top: int = 5, least: float = 0.0) -> DataFrame:
        """``question, doc_id, node_id, score, rank, relevance``: sentences by BM25 over their own words and their headings' titles.

        ``questions`` has ``question, text``; ``scope`` (``doc_id, node_id``) narrows what is
        searched, and with it the statistics.
        """
        lines = nodes.where("kind = 'sentence'").select("doc_id", "node_id", "start", "end", F.col("title").alias("text"))
        if scope is not None:
            lines = lines.join(scope.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_semi")
        heads = nodes.where("kind = 'heading'").select("doc_id", F.col("title").alias("head"), F.col("start").alias("hs"), F.col("end").alias("he"))
        over = lines.select("doc_id", "node_id", "start", "end").join(heads, "doc_id").where("hs <= start and end <= he").groupBy("doc_id", "node_id").agg(F.array_join(F.collect_list("head"), " ").alias("heads"))
        cards = lines.join(over, ["doc_id", "node_id"], "left").withColumn("card", F.concat_ws(" ", "text", "heads"))
        return lexical.rerank(lexical.bm25(cards, ["doc_id", "node_id"], "card", questions, "question", "text", limit), top, least)

    def retrieve(self, units: DataFrame, nodes: DataFrame, question: str, needs: list[str] | tuple = (), dense: DataFrame | None = None) -> dict[str, DataFrame]:
        """``ranking``, ``packet`` and ``selected`` (``doc_id, paragraph, ...``) of every document for one question.

        The layer beam for the needs and the question and what it left over are fused, with
        ``dense`` (``doc_id, node_id, rank``) if given; the best paragraphs are compared in
        pairs, and chosen by scores under both orders of presentation with what they lean on.
        """
        asks = list(dict.fromkeys([*needs, question]))
        if not question.strip() or not all(n.strip() for n in asks):
            raise ValueError("a question and its needs are texts")
        p = self.policy
        inner = nodes.where(F.col("kind").isin("document", "heading", "section", "paragraph"))
        own = units.select("doc_id", "start", "paragraph", "text")
        below = inner.select("doc_id", "node_id", "start", "end").join(own.withColumnRenamed("start", "ps"), "doc_id").where("start <= ps and ps < end")
        body = below.groupBy("doc_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ps", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
        names = [f"s{k}" for k in range(len(asks))]
        rows = inner.join(body, ["doc_id", "node_id"], "left").withColumn("body", F.coalesce("body", F.lit("")))
        scored = rows.select("doc_id", "node_id", "parent_id", "kind", "start", *[self.score(F.col("body"), F.lit(a)).alias(n) for n, a in zip(names, asks, strict=True)])
        steps = written(walk.trace(scored, names, p.search))
        ranked = walk.ranking(steps)
        if dense is not None:
            lists = ranked.select("doc_id", "node_id", "rank").withColumn("source", F.lit("tree")).unionByName(dense.where(F.col("rank") <= p.dense).select("doc_id", "node_id", "rank").withColumn("source", F.lit("dense")))
            ranked = fusion.fused(lists, "doc_id", "node_id")
        at = nodes.where("kind = 'paragraph'").select("doc_id", "node_id", "start")
        cards = ranked.join(at, ["doc_id", "node_id"]).join(own, ["doc_id", "start"]).withColumn("question", F.lit(question)).select("doc_id", "paragraph", "rank", "text", "question")
        even = lambda a, b: 0.5 + (self.score(a["text"], a["question"]) - self.score(b["text"], b["question"])) / 2
        pairs = written(select.pairwise_wins(cards, "doc_id", "paragraph", "rank", self.prefer or even, p.agreement, p.pairwise))
        given = pairs.withColumn("question", F.lit(question))
        packed = packet.packet(given, packet.links(units, p.allowance), "question", p.shared)
        targets = packed.where("is_target").join(own.select("doc_id", "paragraph", "text"), ["doc_id", "paragraph"]).join(pairs.select("doc_id", "paragraph", "rank"), ["doc_id", "paragraph"])
        shared = targets.withColumn("forward", self.score(F.col("text"), F.lit(question))).withColumn("backward", F.col("forward"))
        chosen = select.joint_selection(shared, "doc_id", "paragraph", "rank", "forward", "backward", p.output)
        return {"trace": steps, "ranking": ranked, "pairwise": pairs, "packet": packed, "selected": chosen.where("selected").join(own, ["doc_id", "paragraph"])}

    def read(self, docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
        """``doc_id, node_id, text, first_line, last_line, sha`` of wanted nodes (``doc_id, node_id``)."""
        rows = nodes.join(wanted, ["doc_id", "node_id"], "left_semi")
        return tree.citations(rows, docs).join(markdown.with_text(rows.select("doc_id", "node_id", "start", "end"), docs).select("doc_id", "node_id", "text"), ["doc_id", "node_id"])


class Navigator:
    """A reader that looks for passages, reads them, goes up and finishes with what it has read; ``choose`` decides each step.

    ``choose(state)`` gets the steps so far and gives ``{"action": "find", "need": ...}``,
    ``{"action": "read" or "up", "doc_id": ..., "node_id": ...}`` or ``{"action": "finish", "nodes": [...]}``.
    The driver holds only what was read, at most ``characters`` of it.
    """

    def __init__(self, engine: Engine, docs: DataFrame, nodes: DataFrame, steps: int = 12, characters: int = 20_000) -> None:
        self.engine, self.docs, self.nodes, self.steps, self.characters = engine, docs, written(nodes), steps, characters

    def _one(self, doc_id, node_id: str) -> dict:
        wanted = self.nodes.where((F.col("doc_id") == doc_id) & (F.col("node_id") == node_id)).select("doc_id", "node_id")
        got = self.engine.read(self.docs, self.nodes, wanted).first()
        if got is None:
            raise ValueError(f"there is no node {node_id} in {doc_id}")
        return got.asDict()

    def run(self, question: str, choose: Callable[[dict], dict]) -> dict:
        held: dict[tuple, dict] = {}
        history: list[dict] = []
        offered: set[tuple] = set()
        spark = self.nodes.sparkSession
        for step in range(self.steps):
            move = choose({"question": question, "history": history, "read": list(held.values()), "steps_left": self.steps - step})
            action = move.get("action")
            if action == "finish":
                keys = [tuple(k) for k in move.get("nodes", [])]
                if not set(keys) <= set(held):
                    raise ValueError("only what was read can be evidence")
                kept = self._outermost(keys) if keys else []
                return {"question": question, "evidence": [held[k] for k in kept], "history": history, "status": "finished"}
            if action == "find":
                asked = spark.createDataFrame([("q", f"{question} {move['need']}")], "question string, text string")
                hits = [r.asDict() for r in self.engine.find(self.docs, self.nodes, asked).orderBy("rank").collect()]
                offered |= {(h["doc_id"], h["node_id"]) for h in hits}
                history.append({"action": "find", "need": move["need"], "hits": hits})
                continue
            key = (move.get("doc_id"), move.get("node_id"))
            if action == "up":
                if key not in held:
                    raise ValueError("only from a node that was read the way leads up")
                above = self.nodes.where((F.col("doc_id") == key[0]) & (F.col("node_id") == key[1])).first()
                key = (key[0], above["parent_id"]) if above and above["parent_id"] else key
            elif action != "read" or key not in offered:
                raise ValueError(f"not a step: {move}")
            text = held.get(key) or self._one(*key)
            if sum(len(h["text"]) for h in held.values()) + (0 if key in held else len(text["text"])) > self.characters:
                history.append({"action": action, "node": key, "refused": "characters"})
                continue
            held[key] = text
            history.append({"action": action, "node": key})
        return {"question": question, "evidence": [], "history": history, "status": "out of steps"}

    def _outermost(self, keys: list[tuple]) -> list[tuple]:
        """The chosen nodes that no other chosen one holds."""
        spark, kind = self.nodes.sparkSession, self.nodes.schema["doc_id"].dataType.simpleString()
        own = self.nodes.where(F.col("doc_id").isin([k[0] for k in keys]))
        kept = {tuple(r) for r in checks.without_covered(spark.createDataFrame(keys, f"doc_id {kind}, node_id string"), tree.paths(own)).collect()}
        return [k for k in dict.fromkeys(keys) if k in kept]


