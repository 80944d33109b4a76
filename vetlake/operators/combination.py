"""Combination analysis over selections of skills: merged profiles, risks, attack chains, conclusion.

``selection``: selection_id, skill_id.  Many selections are analysed in one plan; a single
selection is one with a constant id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import any_of, bound, clean_array, has_text, ws_trim
from ..session import cut_lineage
from .admission import CAPABILITIES, detected_capabilities
from .findings import _array_map

# Chain rules (capabilities, level, priority, parents that fold the chain).
CHAIN_RULES = {
    "sensitive-exfiltration": (["sensitive_data_access", "network_access"], "high", 80, ["full-attack-chain"]),
    "write-exec-chain": (["file_write", "command_exec"], "high", 60, []),
    "remote-command-chain": (["network_access", "command_exec"], "high", 70, ["full-attack-chain"]),
    "full-attack-chain": (["sensitive_data_access", "network_access", "command_exec"], "high", 100, []),
}
# Words by which evidence supports a capability, its attack step and techniques.
EVIDENCE_WORDS = {
    "network_access": ["http", "https://", "outbound", "api"], "command_exec": ["exec", "command", "shell"],
    "sensitive_data_access": ["/root/.netrc", "credential", "token", "secret"], "file_write": ["drop", "write", "file"],
}
ATTACK_STEPS = {
    "sensitive_data_access": "Collect sensitive data", "file_write": "Drop payload or intermediate file",
    "network_access": "Exfiltrate or receive remote command", "command_exec": "Execute local command",
}
STEP_TECHNIQUES = {
    "sensitive_data_access": ["TA0009 Collection", "T1005 Data from Local System"], "file_write": ["TA0003 Persistence", "T1105 Ingress Tool Transfer"],
    "network_access": ["TA0011 Command and Control", "T1071 Application Layer Protocol"], "command_exec": ["TA0002 Execution", "T1059 Command and Scripting Interpreter"],
}


def selection_key(ids: Column) -> Column:
    """SHA-1 of the sorted distinct ids; independent of order and repeats."""
    return F.sha1(F.array_join(F.array_sort(clean_array(ids)), ","))


def selection_keys(selection: DataFrame, owner: str, member: str) -> DataFrame:
    """``owner, key``: ``selection_key`` of each owner's members, for selections of any length.

    A hash of a sorted list is sequential, so an owner's members pass through one task, but one at a time: they are
    made distinct first, sorted by Spark (which spills), and fed to the running hash.  Null and blank members count as none;
    rows without an owner are one owner.
    """
    members = selection.select(F.col(owner).alias("owner"), F.coalesce(ws_trim(F.col(member).cast("string")), F.lit("")).alias("member")).distinct()
    dealt = members.repartition("owner").sortWithinPartitions("owner", "member")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now = digest = kind = None
        some = False  # the open owner has a member

        def ready() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([o for o, _ in done], kind), pa.array([k for _, k in done], pa.string())], names=[owner, "key"])
            done.clear()
            return out

        for batch in batches:
            kind = batch.schema.field("owner").type
            for o, m in zip(batch.column("owner").to_pylist(), batch.column("member").to_pylist()):
                if digest is None or o != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest, some = o, hashlib.sha1(), False
                if m:
                    digest.update((b"," if some else b"") + m.encode())
                    some = True
            if done:
                yield ready()
        if digest is not None:
            done.append((now, digest.hexdigest()))
            yield ready()

    return dealt.mapInArrow(keys, T.StructType([T.StructField(owner, selection.schema[owner].dataType), T.StructField("key", T.StringType())]))


def selected_profiles(selection: DataFrame, profiles: DataFrame) -> DataFrame:
    return selection.select("selection_id", "skill_id").distinct().join(profiles, "skill_id")


def evidence_of(selected: DataFrame, items: DataFrame | None) -> DataFrame:
    """``skill_id, e``: distinct evidence per skill, from all items (skill_id, item) or else from the profiles' own."""
    rows = selected.select("skill_id", F.explode("evidence").alias("e")) if items is None else items.select("skill_id", F.col("item").alias("e"))
    return rows.where(has_text(F.col("e"))).distinct()


def merge_profiles(selected: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """OR of the ten flags with tag list and evidence count per selection.

    Flags combine map-side; tags follow from the merged flags, so no member lists are gathered.
    """
    m = selected.groupBy("selection_id").agg(*[F.bool_or(c).alias(c) for c in CAPABILITIES], F.count("*").alias("n_skills"))
    ev = selected.select("selection_id", "skill_id").join(evidence_of(selected, items), "skill_id")
    n_ev = ev.select("selection_id", ws_trim(F.col("e")).alias("e")).distinct().groupBy("selection_id").agg(F.count("*").alias("n_evidence"))
    return m.join(n_ev, "selection_id", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0))).withColumn("tags", detected_capabilities())


def merge_risks(selection: DataFrame, risks: DataFrame) -> DataFrame:
    """Risks grouped by id and title per selection: level of the first skill and source skills."""
    j = selection.select("selection_id", "skill_id").distinct().join(risks, "skill_id").where((ws_trim(F.col("risk_id")) != "") | (ws_trim(F.col("title")) != ""))
    return j.groupBy("selection_id", "risk_id", "title").agg(F.min_by("level", "skill_id").alias("level"), F.count_distinct("skill_id").alias("n_sources"), F.min("skill_id").alias("first_source"))


def _cited(low: Column, rule: str) -> Column:
    """Evidence item, lower-cased, carries a word of one of the rule's capabilities."""
    return any_of(low.contains(w.lower()) for c in CHAIN_RULES[rule][0] for w in EVIDENCE_WORDS[c])


def cited_items(evidence: DataFrame) -> DataFrame:
    """``skill_id, chain_id, e`` for every item that carries a word of the chain; tested once per skill, not per selection."""
    cells = F.array_compact(F.array(*[F.when(_cited(F.col("_low"), r), F.lit(r)) for r in CHAIN_RULES]))
    # trimmed and lower-cased once, bound cells are not computed again for the generator's test
    low = evidence.select("skill_id", "e", bound(F.lower(ws_trim(F.col("e")))).alias("_low"))
    return low.select("skill_id", "e", bound(cells).alias("_rules")).select("skill_id", "e", F.explode("_rules").alias("chain_id"))


def chain_evidence(selected: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Evidence supporting each chain: selection_id, chain_id, skill_id, evidence (distinct per skill)."""
    cited = cited_items(evidence_of(selected, items))
    return selected.select("selection_id", "skill_id").distinct().join(cited, "skill_id").select("selection_id", "skill_id", "chain_id", F.col("e").alias("evidence"))


def infer_chains(selected: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Chain rules on the merged flags with enough support, from all ``items`` (skill_id, item) of the skills.

    Support: two skills selected, two of the rule's capabilities present, and either two skills
    with cited evidence or one skill covering two capabilities with two cited items.  The
    "distinct skill" test of the source does not require different skills; reproduced.
    Without cited evidence the capability names stand in and support fails.
    """
    cited = cut_lineage(cited_items(evidence_of(selected, items)))  # read for the support and for the count
    per_skill = cited.groupBy("skill_id", "chain_id").agg(F.count("*").alias("cited"))
    cover = {r: sum((F.col(c).cast("int") for c in caps), F.lit(0)) for r, (caps, *_) in CHAIN_RULES.items()}
    skills = selected.select("selection_id", "skill_id", F.explode(F.array(*[F.struct(F.lit(r).alias("chain_id"), cover[r].alias("covered")) for r in CHAIN_RULES])).alias("c")).select("selection_id", "skill_id", "c.*")
    s = skills.join(per_skill, ["skill_id", "chain_id"], "left").groupBy("selection_id", "chain_id").agg(
        F.count("*").alias("n_skills"), F.count_if(F.coalesce("cited", F.lit(0)) > 0).alias("backed"), F.bool_or((F.col("covered") >= 2) & (F.coalesce("cited", F.lit(0)) >= 2)).alias("strong_member"))
    ev = selected.select("selection_id", "skill_id").join(cited, "skill_id").select("selection_id", "chain_id", ws_trim(F.col("e")).alias("e")).distinct().groupBy("selection_id", "chain_id").agg(F.count("*").alias("n_evidence"))
    flags = selected.groupBy("selection_id").agg(*[F.bool_or(c).alias(c) for c in CAPABILITIES])
    need = F.lit(False)
    for r, (caps, *_) in CHAIN_RULES.items():
        have = F.col("chain_id") == r
        for c in caps:
            have = have & F.col(c)
        need = need | have
    meta = F.create_map(*[x for r, (_, lvl, pri, _) in CHAIN_RULES.items() for x in (F.lit(r), F.struct(F.lit(lvl).alias("level"), F.lit(pri).alias("priority")))])
    ok = (F.col("n_skills") >= 2) & ((F.col("backed") >= 2) | F.col("strong_member"))
    return s.join(flags, "selection_id").where(need & ok).join(ev, ["selection_id", "chain_id"]).select(
        "selection_id", "chain_id", F.element_at(meta, F.col("chain_id"))["level"].alias("level"), F.element_at(meta, F.col("chain_id"))["priority"].alias("priority"), "n_skills", "n_evidence")


def fold_chains(chains: DataFrame) -> DataFrame:
    """Drop chains folded by a parent present in the same selection; highest priority first."""
    parents = F.create_map(*[x for r, (*_, fold) in CHAIN_RULES.items() for x in (F.lit(r), F.array(*[F.lit(f) for f in fold]).cast("array<string>"))])
    present = chains.select("selection_id", F.col("chain_id").alias("parent"))
    folded = chains.select("selection_id", "chain_id", F.explode(F.element_at(parents, F.col("chain_id"))).alias("parent")).join(present, ["selection_id", "parent"], "left_semi").select("selection_id", "chain_id")
    return chains.join(folded, ["selection_id", "chain_id"], "left_anti").orderBy("selection_id", F.desc("priority"), "chain_id")


def attack_path(chain_id: Column) -> Column:
    steps = {r: [ATTACK_STEPS[c] for c in caps] for r, (caps, *_) in CHAIN_RULES.items()}
    return F.element_at(_array_map(steps), chain_id)


def chain_techniques(chain_id: Column) -> Column:
    t = {r: list(dict.fromkeys(x for c in caps for x in STEP_TECHNIQUES[c])) for r, (caps, *_) in CHAIN_RULES.items()}
    return F.element_at(_array_map(t), chain_id)


def conclusion(selection: DataFrame, merged: DataFrame, risks: DataFrame, chains: DataFrame) -> DataFrame:
    """Counts and overall level per selection: high / medium / low."""
    lvl = F.lower(ws_trim(F.col("level")))
    r = risks.groupBy("selection_id").agg(*[F.count_if(lvl == x).alias(f"{x}_risks") for x in ("high", "medium", "low")])
    c = chains.groupBy("selection_id").agg(F.count("*").alias("n_chains"), F.count_if((lvl == "high") & (F.col("n_skills") >= 2) & (F.col("n_evidence") >= 2)).alias("confident_chains"))
    base = selection.select("selection_id").distinct()
    m = merged.select("selection_id", F.col("n_skills"), F.size("tags").alias("n_capabilities"),
                      (F.col("network_access").cast("int") + F.col("command_exec").cast("int") + F.col("sensitive_data_access").cast("int") + F.col("privilege_use").cast("int")).alias("n_sensitive"))
    j = base.join(m, "selection_id", "left").join(r, "selection_id", "left").join(c, "selection_id", "left").fillna(0)
    level = (F.when((F.col("high_risks") > 0) | (F.col("confident_chains") > 0), F.lit("high"))
             .when((F.col("medium_risks") > 0) | (F.col("n_sensitive") >= 3) | ((F.col("n_sensitive") >= 2) & (F.col("n_chains") > 0)), F.lit("medium")).otherwise(F.lit("low")))
    return j.withColumn("risk_level", level)


def list_runs(runs: DataFrame, start: str | None = None, end: str | None = None, level: str | None = None, query: str | None = None, ascending: bool = False) -> DataFrame:
    """Saved runs by update day (end day inclusive), level and text over ids, capabilities and tags.

    ``runs``: run_id, risk_level, selected, capabilities, tags (arrays), updated_at (epoch seconds).
    """
    out = runs
    if start:
        out = out.where(F.col("updated_at") >= F.unix_timestamp(F.lit(start), "yyyy-MM-dd"))
    if end:
        out = out.where(F.col("updated_at") < F.unix_timestamp(F.lit(end), "yyyy-MM-dd") + 86400)
    if level:
        out = out.where(F.lower(ws_trim(F.col("risk_level"))) == level.lower())
    if query:
        q = query.strip().lower()
        arrays = F.concat("selected", "capabilities", "tags")
        out = out.where(F.lower("run_id").contains(q) | F.exists(arrays, lambda x: F.lower(x).contains(q)))
    return out.orderBy("updated_at" if ascending else F.desc("updated_at"), "run_id")


# Capabilities that complete a chain when held by two different skills.
COMPLEMENT = [("network_access", "sensitive_data_access"), ("command_exec", "file_write"), ("command_exec", "network_access")]


def pairwise_summary(profiles: DataFrame) -> DataFrame:
    """Risky pairs of the whole registry, counted exactly per complementary capability pair.

    For each (A, B) the unordered pairs in which one skill holds A and the other B number
    |A|·|B| − |A∩B| − C(|A∩B|, 2): pairs inside A∩B would otherwise be counted twice and a
    skill cannot pair with itself.  One aggregation pass; pairs are not listed, since their
    number grows with the square of the registry.
    """
    cells = []
    for a, b in COMPLEMENT:
        cells.append(F.struct(F.lit(f"{a}+{b}").alias("pair"), F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(F.col(a) & F.col(b)).alias("n_ab")))
    agg = profiles.agg(F.array(*cells).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    nab = F.col("n_ab")
    return agg.withColumn("n_pairs", (F.col("n_a") * F.col("n_b") - nab - (nab * (nab - 1) / 2)).cast("long"))


def pairwise_combinations(profiles: DataFrame, partition: str) -> DataFrame:
    """Risky pairs among skills sharing a ``partition`` value, listed as counts per skill.

    For every skill: how many partners in its partition complete it for each capability pair.
    Partner counts come from one aggregate per partition joined back on the equi key, so the
    output has one row per skill and pair however large a partition is.
    """
    out = None
    for a, b in COMPLEMENT:
        g = profiles.groupBy(partition).agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(F.col(a) | F.col(b)).alias("n_any"))
        j = profiles.select("skill_id", partition, F.col(a).alias("a"), F.col(b).alias("b")).join(g, partition)
        # with both: any holder of A or B completes it; with A only: holders of B; with B only: holders of A
        n = F.when(F.col("a") & F.col("b"), F.col("n_any") - 1).when(F.col("a"), F.col("n_b")).when(F.col("b"), F.col("n_a")).otherwise(F.lit(0))
        p = j.select(partition, "skill_id", F.lit(f"{a}+{b}").alias("pair"), n.alias("n_partners")).where("n_partners > 0")
        out = p if out is None else out.unionByName(p)
    return out
