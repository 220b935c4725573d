"""Audit: checks over manifests (quick) and over all rows (full), as one table of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certloom.errors import UsageError, VerificationError
from certloom.functions.certificates import built, table_rows
from certloom.functions.merkle import CHUNK_LEVELS, CompactRange, subtree_roots
from certloom.operators.numbering import durable
from certloom.plans.heads import kept_head
from certloom.sources.dataset import Dataset, Snapshot, content_sum
from certloom.sources.loglist import LogRegistry, check_key
from certloom.sources.schemas import SOURCE, TABLES, columns, ddl_of
from certloom.sources.tiles import verify_head

#: Problems listed for one check at most; the count is always whole.
LISTED = 100


def contiguity(batches: DataFrame) -> DataFrame:
    """Batches that do not start right behind the one before of their log: log, first, expected."""
    by = Window.partitionBy("log").orderBy("commit_seq")
    expected = F.coalesce(F.lag("last").over(by) + 1, F.lit(0))
    return batches.withColumn("expected", expected).where(F.col("first") != F.col("expected")).select("log", "first", "expected")


def missing_commits(batches: DataFrame) -> DataFrame:
    """Commit numbers from 1 to the last that no batch has."""
    last = batches.agg(F.max("commit_seq").alias("n"))
    every = last.where(F.col("n").isNotNull()).select(F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("commit_seq"))
    return every.join(batches.select("commit_seq"), "commit_seq", "left_anti")


def id_overlaps(batches: DataFrame) -> DataFrame:
    """Batches whose certificate ids begin within those of earlier commits: commit_seq, low, before."""
    before = F.max("high").over(Window.orderBy("commit_seq").rowsBetween(Window.unboundedPreceding, -1))
    return batches.where(F.col("low").isNotNull()).withColumn("before", before).where(F.col("low") <= F.col("before")).select("commit_seq", "low", "before")


def record_mismatches(vault: DataFrame, certs: DataFrame) -> DataFrame:
    """cert_id and problem for records and rows that lack each other or differ.

    Columns that both tables have are compared, nulls being equal: a record's columns beyond its
    bytes and its hash must be those of its row.
    """
    shared = [c for c in vault.columns if c in certs.columns and c not in ("cert_id", "sha256", "log", "batch")]
    rebuilt = vault.select("cert_id", F.lower(F.hex("sha256")).alias("v_sha"), F.sha2("der", 256).alias("v_hash"), *[F.col(c).alias(f"v_{c}") for c in shared])
    both = rebuilt.join(certs.select("cert_id", F.col("sha256").alias("c_sha"), *[F.col(c).alias(f"c_{c}") for c in shared]), "cert_id", "full_outer")
    problem = (
        F.when(F.col("c_sha").isNull(), "no certs row")
        .when(F.col("v_sha").isNull(), "no record")
        .when(F.col("v_hash") != F.col("v_sha"), "bytes do not hash to sha256")
        .when(F.col("c_sha") != F.col("v_sha"), "sha256 differs")
    )
    for c in shared:
        problem = problem.when(~F.col(f"v_{c}").eqNullSafe(F.col(f"c_{c}")), f"{c} differs")
    return both.select("cert_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def field_mismatches(built: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and field of every row whose field differs between two tables of the same rows; a missing row differs in its key."""
    a = built.select(F.col(key).alias("k"), F.struct(*[F.col(c).alias(c) for c in fields]).alias("a"))
    b = stored.select(F.col(key).alias("k2"), F.struct(*[F.col(c).alias(c) for c in fields]).alias("b"))
    both = a.join(b, F.col("k") == F.col("k2"), "full_outer")
    tests = [F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(key))]
    tests += [F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields]
    listed = F.filter(F.array(*tests), lambda x: x.isNotNull())
    return both.select(F.coalesce("k", "k2").alias(key), F.explode(listed).alias("field"))


def dangling(entries: DataFrame, chains: DataFrame, names: DataFrame, certs: DataFrame) -> DataFrame:
    """table and cert_id of references to certificates that do not exist."""
    refs = None
    for table, df in (("entries", entries), ("chains", chains), ("names", names)):
        one = df.where(F.col("cert_id").isNotNull()).select(F.lit(table).alias("table"), "cert_id").distinct()
        refs = one if refs is None else refs.unionByName(one)
    return refs.join(certs.select("cert_id"), "cert_id", "left_anti").select("table", "cert_id")


def content_hash(df: DataFrame) -> str:
    """A hash of rows as a set with repeats, whatever their order: the same in every process.

    A row's hash covers which of its columns are null, as xxhash64 passes over nulls.
    """
    return df.agg(content_sum(df.columns).alias("c")).first()["c"]


def tree_roots(dataset: Dataset, snap: Snapshot, log: str, together: int = 64) -> list[str]:
    """Where the entries of a log stop hashing to the committed roots.

    Whole subtrees are folded on the executors for `together` batches in one job; the driver gets
    one hash for each of them and the leaves of the subtrees in which a batch ends.
    """
    unit, tree = 1 << CHUNK_LEVELS, CompactRange()
    batches = [m for m in snap.batches if m["log"] == log]
    for at in range(0, len(batches), together):
        part = batches[at : at + together]
        low, high = part[0]["first"], part[-1]["last"] + 1
        nodes = dataset.table("entries", snap, part).select("idx", F.col("leaf_hash").alias("hash"))
        chunk = F.shiftright("idx", CHUNK_LEVELS)
        cut = sorted({x // unit for m in part for x in (m["first"], m["last"] + 1) if x % unit})
        whole = nodes.where((F.col("idx") >= -(-low // unit) * unit) & (F.col("idx") < high // unit * unit) & ~chunk.isin(cut))
        roots = {r["idx"]: bytes(r["hash"]) for r in subtree_roots(whole).collect()}
        leaves = {r["idx"]: bytes(r["hash"]) for r in nodes.where(chunk.isin(cut)).collect()} if cut else {}
        for m in part:
            while tree.size <= m["last"]:
                if tree.size % unit == 0 and tree.size // unit in roots and tree.size + unit <= m["last"] + 1:
                    tree.append(roots[tree.size // unit], CHUNK_LEVELS)
                elif tree.size in leaves:
                    tree.append(leaves[tree.size])
                else:
                    return [f"{log}: entry {tree.size} is missing"]
            if tree.root().hex() != m["tree"]["root"]:
                return [f"{log}: another root at {m['last'] + 1}"]
    return []


def verify(dataset: Dataset, full: bool = False, as_of: int = 0) -> DataFrame:
    """check, status (ok, FAIL, skipped), n (problems) and examples of each check.

    Quick checks read manifests and sizes. full: also checksums of all files, records against rows,
    references, roots, kept heads, and derived tables built again. A check is skipped where there is
    nothing to check it with: heads that were kept without a signature.
    """
    spark = dataset.spark
    snap = dataset.snapshot(allow_mixed=True)
    if as_of > snap.as_of:
        raise UsageError(f"commit {as_of} does not exist yet; the last is {snap.as_of}")
    snap = dataset.snapshot(as_of, allow_mixed=True)
    found: list[tuple[str, str, int, list[str]]] = []

    def check(name: str, problems, skipped: bool = False) -> None:
        if isinstance(problems, DataFrame):
            problems = durable(problems)
            n = problems.count()
            problems = (n, [str(tuple(r)) for r in problems.limit(LISTED).collect()] if n else [])
        else:
            problems = (len(problems), problems[:LISTED])
        found.append((name, "skipped" if skipped else "FAIL" if problems[0] else "ok", *problems))

    rows = [(m["commit_seq"], m["log"], m["first"], m["last"], *(m["cert_id_range"] or [None, None])) for m in snap.batches]
    batches = spark.createDataFrame(rows, "commit_seq bigint, log string, first bigint, last bigint, low bigint, high bigint")
    check("batches are contiguous", contiguity(batches))
    check("no commit is missing", missing_commits(batches))
    check("certificate ids do not overlap", id_overlaps(batches))
    sizes = []
    for m in snap.batches:
        for t, f in m["files"].items():
            folder = dataset.folder(t, m, f.get("version"))
            if not dataset.store.exists(folder) or dataset.store.size(folder) != f["bytes"]:
                sizes.append(f"{folder}: not the {f['bytes']} bytes committed")
    check("files are as committed", sizes)
    trees = [f"{m['log']}: tree of {m['tree']['size']} at batch end {m['last'] + 1}" for m in snap.batches if m["tree"]["size"] != m["last"] + 1]
    check("trees end with their batches", trees)
    if full:
        vault, certs = dataset.table("vault", snap), dataset.table("certs", snap)
        differ = []
        for t in (*SOURCE, *TABLES):
            declared = [n for n, _ in columns(ddl_of(t, snap.active.get(t)))]
            folders = {dataset.store.path(dataset.folder(t, m, m["files"][t].get("version"))): m["files"][t]["content"] for m in snap.batches if t in m["files"]}
            for folder, content in folders.items():
                rows = spark.read.schema(ddl_of(t, snap.active.get(t))).parquet(folder)
                if content_hash(rows.select(declared)) != content:
                    differ.append(f"{folder}: not the content committed")
        check("checksums are as committed", differ)
        check("records match certs", record_mismatches(vault, certs))
        check("references exist", dangling(dataset.table("entries", snap), dataset.table("chains", snap), dataset.table("names", snap), certs))
        check("entries hash to the committed roots", [x for log in sorted(snap.tips()) for x in tree_roots(dataset, snap, log)])
        unsigned, problems = False, []
        for log, tip in sorted(snap.tips().items()):
            head, pinned = kept_head(dataset, log), LogRegistry(dataset).all().get(log, {})
            if head is None or not head.signature or not pinned.get("key"):
                unsigned = True
            else:
                try:
                    verify_head(spark, head, check_key(pinned["key"], pinned["log_id"]))
                    if head.size < tip["tree"]["size"]:
                        problems.append(f"{log}: the kept head of {head.size} is behind the committed tree of {tip['tree']['size']}")
                    elif head.size == tip["tree"]["size"] and head.root.hex() != tip["tree"]["root"]:
                        problems.append(f"{log}: the kept head of {head.size} has another root")
                except VerificationError as e:
                    problems.append(f"{log}: {e}")
        check("kept heads are signed", problems, skipped=unsigned and not problems)
        kinds = vault.join(certs.select("cert_id", "kind"), "cert_id").select("cert_id", "sha256", "kind", "delta_base_cert_id", "der")
        parsed = durable(built(kinds))
        differ = []
        for t in TABLES:
            names = [n for n, _ in columns(ddl_of(t))]
            again, stored = table_rows(parsed, t).select(names), dataset.table(t, snap).select(names)
            if content_hash(again) != content_hash(stored):
                fields = field_mismatches(again, stored, "cert_id", names[1:]).limit(3).collect() if t == "certs" else []
                differ.append(f"{t} differs from what its certificates give" + "".join(f"; {r['field']} of {r['cert_id']}" for r in fields))
        check("derived tables match their certificates", differ)
    return spark.createDataFrame(found, "check string, status string, n bigint, examples array<string>")
