"""The engine: the store's tables and one method for each request."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalized_name
from tessera.operators import access, extraction, mutate, ranking, rendering, vectors
from tessera.operators import messages as M
from tessera.plans import maintenance
from tessera.plans import recall as R
from tessera.sources.config import NODE_TYPES, Config
from tessera.sources.schemas import TABLES
from tessera.sources.snapshots import Store
from tessera.streaming.sessions import Cache, Circuit, retried, with_deadline


@dataclass
class Engine:
    """embed: texts to vectors; complete: (system, user) to text. Both may be None: then searches are
    textual, and requests that need a model raise."""

    spark: SparkSession
    root: str
    clock: Callable[[], int]
    config: Config = field(default_factory=Config)
    embed: Callable[[list[str]], list[list[float]]] | None = None
    complete: Callable[[str, str], str] | None = None

    pause: Callable[[float], None] = time.sleep

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root, TABLES)
        self.cache = Cache(self.config.recall_cache_ttl_ms)
        self.circuit = Circuit(self.config.breaker_max_timeouts, self.config.breaker_cooldown_ms)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def _named(self, name: str) -> DataFrame:
        found = access.by_name(access.active(self.table("nodes")), name)
        if found.isEmpty():
            raise KeyError(f"no active node is named {name}")
        return found

    def _vector(self, text: str) -> list[float] | None:
        return retried(lambda: self.embed([text])[0], self.pause) if self.embed else None

    def search(self, text: str) -> R.Result:
        return R.recall(self.table("nodes"), self.table("edges"), self.table("vectors"), self._vector(text), text, self.clock(), self.config)

    def search_text(self, text: str) -> DataFrame:
        found = self.search(text)
        return rendering.search_lines(ranking.display_scores(found.nodes.filter("tier <> 'filtered'")))

    def recall(self, history: str, prompt: str, session_id: str = "") -> R.Result | None:
        """What two searches find, before a prompt. The same question on the same tables is answered
        from the cache for a while. None at the deadline, and while the session rests after too many
        timeouts: a prompt goes on without."""
        now = self.clock()
        if self.circuit.rests(session_id, now):
            return None
        key = "\x1f".join([session_id, history, prompt, *(str(self.store.version(t)) for t in ("nodes", "edges", "vectors"))])
        found = self.cache.get(key, now)
        if found is None:
            try:
                found = with_deadline(self.spark, self.config.recall_timeout_ms / 1000, lambda: R.parallel_recall(self.search(history), self.search(prompt)))
            except TimeoutError:
                self.circuit.timed_out(session_id, self.clock())
                return None
            self.cache.put(key, found, self.clock())
        self.circuit.answered(session_id)
        return found

    def record(self, answers: DataFrame, session_id: str, flags: list[str] | None = None) -> None:
        """answers: raw, seq - what a model extracted. Nodes, then edges among named nodes."""
        now = self.clock()
        parsed = extraction.extraction(answers).filter("not error")
        rows = parsed.select("seq", F.explode("nodes").alias("n")).select("seq", "n.*", F.lit(session_id).alias("session_id"), F.array(*map(F.lit, flags or [])).cast("array<string>").alias("flags"))
        nodes = mutate.upsert_nodes(self.table("nodes"), rows, now)
        ids = nodes.select("name", "id")
        links = parsed.select("seq", F.explode("edges").alias("e")).select("seq", F.col("e.from").alias("_f"), F.col("e.to").alias("_t"), "e.name", "e.description", F.lit(session_id).alias("session_id"))
        links = links.join(ids.toDF("_f", "from_id"), "_f").join(ids.toDF("_t", "to_id"), "_t").select("from_id", "to_id", "name", "description", "session_id", "seq")
        beliefs = parsed.select("seq", F.posexplode("beliefs").alias("pos", "b")).select(F.col("b.node_name"), F.col("b.verdict"), F.col("b.weight"), F.lit(session_id).alias("session_id"), F.concat_ws(":", "seq", "pos").alias("part"))
        edges = mutate.upsert_edges(self.table("edges"), links, nodes, now)
        signals = mutate.named_beliefs(nodes, beliefs)
        nodes = mutate.applied_beliefs(nodes, signals).drop("before", "delta")
        key = mutate.stable_id("b", F.col("node_id"), F.lit(session_id), F.lit(str(now)), F.col("part"))
        logged = signals.select(key.alias("id"), "node_id", "signal_type", "weight", "session_id", F.lit(now).cast("long").alias("created_at"))
        self.store.commit({"nodes": nodes, "edges": edges, "belief_signals": mutate.appended(self.table("belief_signals"), logged)})

    def record_text(self, session_id: str, system: str, prompt: str) -> None:
        if self.complete is None:
            raise RuntimeError("no model is set")
        self.record(self.spark.createDataFrame([(retried(lambda: self.complete(system, prompt), self.pause), 0)], "raw string, seq int"), session_id)

    def stats(self) -> DataFrame:
        return access.stats(self.table("nodes"), self.table("edges"))

    def belief_stats(self) -> DataFrame:
        return access.belief_stats(self.table("nodes"), self.table("belief_signals"))

    def maintain(self, protected: DataFrame, days: int = 90) -> DataFrame:
        t = maintenance.Tables(*(self.table(n) for n in ("nodes", "edges", "vectors", "messages", "recalled")))
        t, report = maintenance.maintain(t, protected, self.clock(), days, self.config)
        self.store.commit({"nodes": t.nodes, "edges": t.edges, "vectors": t.vectors, "messages": t.messages, "recalled": t.recalled})
        return report

    def hot(self) -> DataFrame:
        return access.hot(self.table("nodes"))

    def scope_hot(self, scopes: list[str]) -> DataFrame:
        return access.scope_hot(self.table("nodes"), scopes)

    def set_flags(self, name: str, flags: list[str]) -> None:
        new = self._named(name).select("id", F.array(*map(F.lit, flags)).cast("array<string>").alias("new_flags"))
        self.store.commit({"nodes": mutate.set_flags(self.table("nodes"), new, self.clock())})

    def get_node(self, name: str) -> dict[str, DataFrame]:
        node_id = self._named(name).first()["id"]
        return access.full_info(self.table("nodes"), self.table("edges"), self.table("belief_signals"), node_id)

    def edit_node(self, name: str, description: str | None = None, content: str | None = None, node_type: str | None = None) -> None:
        if description is None and content is None:
            raise ValueError("a description or a content is needed")
        if node_type is not None and node_type not in NODE_TYPES:
            raise ValueError(f"no such type: {node_type}")
        values = [F.lit(v).cast("string").alias(f"new_{c}") for c, v in (("description", description), ("content", content), ("type", node_type))]
        self.store.commit({"nodes": mutate.update_fields(self.table("nodes"), self._named(name).select("id", *values), self.clock())})

    def set_hot(self, name: str) -> None:
        self.store.commit({"nodes": mutate.add_flag(self.table("nodes"), self._named(name), "hot", self.clock())})

    def set_scope_hot(self, name: str, scope: str) -> None:
        self.store.commit({"nodes": mutate.add_flag(self.table("nodes"), self._named(name), f"scope_hot:{scope}", self.clock())})

    def get_flags(self, name: str) -> DataFrame:
        return access.flags_of(self.table("nodes"), name)

    def set_scope(self, session_id: str, names: list[str]) -> None:
        rows = self.spark.createDataFrame([(n,) for n in names], "scope_name string")
        self.store.commit({"scopes": mutate.set_scopes(self.table("scopes"), session_id, rows, self.clock())})

    def get_scope(self, session_id: str) -> DataFrame:
        return access.scopes_of(self.table("scopes"), session_id)

    def list_scopes(self) -> DataFrame:
        return access.list_scopes(self.table("scopes"))

    def remove(self, name: str) -> None:
        nodes, edges = mutate.removed(self.table("nodes"), self.table("edges"), self._named(name), self.clock())
        self.store.commit({"nodes": nodes, "edges": edges})

    def merge(self, keep: str, lost: str) -> None:
        """Of any types; by hand only."""
        a, b = self._named(keep).first()["id"], self._named(lost).first()["id"]
        if a == b:
            raise ValueError("a node can't be merged with itself")
        m = self.spark.createDataFrame([(b, a)], "merge_id string, keep_id string")
        self.store.commit({"nodes": mutate.merged_nodes(self.table("nodes"), m, self.clock()), "edges": mutate.merged_edges(self.table("edges"), m)})

    def embedding_state(self) -> DataFrame:
        return vectors.embedding_state(self.table("nodes"), self.table("vectors")).groupBy("state").count()

    def embed_all(self, confirm: bool = False, force: bool = False) -> DataFrame:
        """What would be embedded; with confirm it is."""
        if confirm:
            if self.embed is None:
                raise RuntimeError("no embedding provider is set")
            new = vectors.embedded(self.table("nodes"), self.table("vectors"), self.embed, force)
            self.store.commit({"vectors": vectors.save(self.table("vectors"), new, self.clock())})
        return self.embedding_state()

    def induce_topics(self, names: list[str], system: str = "") -> None:
        """Topics from the model for some nodes; only allowed kinds of edges are kept."""
        if self.complete is None:
            raise RuntimeError("no model is set")
        nodes, edges = self.table("nodes"), self.table("edges")
        wanted = self.spark.createDataFrame([(n,) for n in names], "name string").select(normalized_name(F.col("name")).alias("name"))
        semantic = access.active(nodes).join(wanted, "name", "left_semi").filter("type not in ('TOPIC', 'SESSION')")
        topics = access.topics(nodes).orderBy(F.desc("updated_at"), "id").limit(50)
        prompt = rendering.induction_input(topics, semantic, access.induced_edges(edges, semantic)).first()["text"]
        answer = self.spark.createDataFrame([(retried(lambda: self.complete(system, prompt), self.pause), 0)], "raw string, seq int")
        self.apply_topics(answer, "induction")

    def apply_topics(self, answers: DataFrame, session_id: str) -> None:
        now = self.clock()
        p = extraction.induction(answers)
        rows = p.select("seq", F.explode("nodes").alias("n")).select("seq", F.lit("TOPIC").alias("type"), "n.*", F.lit(session_id).alias("session_id"), F.array().cast("array<string>").alias("flags"))
        nodes = mutate.upsert_nodes(self.table("nodes"), rows, now)
        links = p.select("seq", F.explode("edges").alias("e")).select("seq", F.col("e.from").alias("from_name"), F.col("e.to").alias("to_name"), "e.name", "e.description")
        ok = extraction.allowed_edges(links, access.active(nodes).select("name", "type"))
        ids = nodes.select("name", "id")
        ok = ok.join(ids.toDF("from_name", "from_id"), "from_name").join(ids.toDF("to_name", "to_id"), "to_name").select("from_id", "to_id", "name", "description", F.lit(session_id).alias("session_id"), "seq")
        self.store.commit({"nodes": nodes, "edges": mutate.upsert_edges(self.table("edges"), ok, nodes, now)})

    def explore(self, name: str, limit: int | None = None) -> R.Result:
        node = self._named(name)
        text = node.select(vectors.embed_text().alias("t")).first()["t"]
        return R.explore(self.table("nodes"), self.table("edges"), self.table("vectors"), node, self._vector(text), self.clock(), self.config, limit)

    def dream(self, seed: str) -> R.Result:
        return R.dream(self.table("nodes"), self.table("edges"), self.table("vectors"), self.table("recalled"), self.clock(), seed, self.config)

    def stable_context(self, scopes: list[str], session_id: str) -> DataFrame:
        nodes = self.table("nodes")
        active = access.of_session(nodes, session_id).limit(0 if not self.config.compact_enabled else 2**31 - 1)
        return rendering.stable_context(access.scope_hot(nodes, scopes), access.hot(nodes), M.compacted(active, self.config.compact_max))

    def induce_session(self, session_id: str, answers: DataFrame) -> None:
        """answers: raw, seq - a model's summary of the session. It becomes the session's node, with a
        plain sentence where the model gave none, and active nodes of the session link to it."""
        now = self.clock()
        p = extraction.session_summary(answers)
        plain = F.lit(f"session {session_id}")
        some = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise(plain)
        rows = p.select(F.lit(f"session-{session_id}").alias("name"), F.lit("SESSION").alias("type"), some("description").alias("description"), some("summary").alias("content"), F.lit(session_id).alias("session_id"), F.array().cast("array<string>").alias("flags"), "seq")
        nodes = mutate.upsert_nodes(self.table("nodes"), rows, now)
        own = access.active(nodes).filter(F.array_contains("source_sessions", session_id)).withColumn("session_id", F.lit(session_id))
        named = F.col("name") == normalized_name(F.lit(f"session-{session_id}"))
        links = mutate.session_links(own.filter("type <> 'SESSION'"), own.filter("type = 'SESSION'").filter(named))
        self.store.commit({"nodes": nodes, "edges": mutate.upsert_edges(self.table("edges"), links, nodes, now)})

    def end_session(self, session_id: str, final: DataFrame, summary: DataFrame, protected: DataFrame) -> DataFrame:
        """What follows a session's end, one step after another; the maintenance report."""
        self.finalize(session_id, final)
        self.induce_session(session_id, summary)
        return self.maintain(protected)

    def finalize(self, session_id: str, answers: DataFrame) -> None:
        """A session's end: promoted skills, links, invalid nodes; then support for what it used."""
        now = self.clock()
        p = extraction.finalization(answers)
        skills = p.select("seq", F.explode("skills").alias("n")).select("seq", "n.*", F.lit(session_id).alias("session_id"), F.array().cast("array<string>").alias("flags")).withColumn("description", F.coalesce("description", F.lit("")))
        links = p.select("seq", F.explode("edges").alias("e")).select("seq", F.col("e.from").alias("from_name"), F.col("e.to").alias("to_name"), "e.name", "e.description", F.lit(session_id).alias("session_id"))
        gone = p.select(F.explode("invalid").alias("id"))
        nodes, edges = mutate.finalized(self.table("nodes"), self.table("edges"), skills, links, gone, now)
        support = mutate.session_support(nodes, session_id)
        logged = support.select(mutate.stable_id("b", F.col("node_id"), F.lit(session_id), F.lit(str(now))).alias("id"), "node_id", "signal_type", F.col("logged_weight").alias("weight"), "session_id", F.lit(now).cast("long").alias("created_at"))
        signals = mutate.appended(self.table("belief_signals"), logged)
        self.store.commit({"nodes": mutate.applied_beliefs(nodes, support).drop("before", "delta"), "edges": edges, "belief_signals": signals})

