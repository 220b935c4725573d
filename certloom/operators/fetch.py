"""Certificates by identity: bytes, names, chains, entries, and the other half of an issuance."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.errors import NotFound, VerificationError
from certloom.operators.search import batches_for
from certloom.sources.dataset import Dataset, Snapshot

#: Precertificate and certificate of one issuance are logged within so long of each other.
LINK_WINDOW = "INTERVAL 7 DAYS"


class Fetcher:
    def __init__(self, dataset: Dataset, snap: Snapshot):
        self.dataset, self.snap = dataset, snap

    def _batches(self, cert_id: int) -> tuple[list[dict], list[dict]]:
        return batches_for(self.snap, [cert_id])

    def row(self, key: str | int) -> dict:
        """The certs row of a SHA-256 or a cert_id. The id's batch is known from the manifests."""
        if isinstance(key, int) or key.isdigit() and len(key) < 64:
            certs = self.dataset.table("certs", self.snap, self._batches(int(key))[0]).where(F.col("cert_id") == int(key))
        else:
            certs = self.dataset.table("certs", self.snap).where(F.col("sha256") == key.lower())
        found = certs.first()
        if found is None:
            raise NotFound(f"no certificate {key}")
        return found.asDict()

    def fetch(self, key: str | int) -> tuple[dict, bytes]:
        """(certs row, DER), the bytes checked against the row's SHA-256."""
        row = self.row(key)
        vault = self.dataset.table("vault", self.snap, self._batches(row["cert_id"])[0])
        found = vault.where(F.col("cert_id") == row["cert_id"]).select("der").first()
        if found is None or hashlib.sha256(found["der"]).hexdigest() != row["sha256"]:
            raise VerificationError(f"the bytes of certificate {row['cert_id']} are missing or not what they should be")
        return row, bytes(found["der"])

    def names(self, cert_id: int) -> DataFrame:
        """The certificate's names, in the order of ingest."""
        rows = self.dataset.table("names", self.snap, self._batches(cert_id)[0]).where(F.col("cert_id") == cert_id)
        at = F.col("_metadata.row_index") if self._batches(cert_id)[0] else F.lit(0)
        return rows.withColumn("__at", at).orderBy("__at").drop("__at", "log", "batch")

    def count_names(self, name: str) -> int:
        return self.dataset.table("names", self.snap).where(F.col("name") == name).count()

    def entries(self, cert_id: int) -> DataFrame:
        """Log entries of the certificate."""
        return self.dataset.table("entries", self.snap, self._batches(cert_id)[1]).where(F.col("cert_id") == cert_id).orderBy("log", "idx")

    def chains(self, cert_id: int) -> DataFrame:
        """chain_id and certs (ids by position) of its different chains, first served first."""
        order = self.dataset.spark.createDataFrame(
            [(m["log"], f"{m['first']:012d}-{m['last']:012d}", m["commit_seq"]) for m in self.snap.batches], "log string, batch string, seq bigint"
        )
        mine = self.entries(cert_id).where(F.col("chain_id").isNotNull()).join(F.broadcast(order), ["log", "batch"])
        firsts = mine.groupBy("chain_id").agg(F.min(F.struct("seq", "idx")).alias("first"))
        links = self.dataset.table("chains", self.snap).join(firsts, "chain_id")
        listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "cert_id"))), lambda x: x["cert_id"])
        return links.groupBy("chain_id", "first").agg(listed.alias("certs")).orderBy("first").select("chain_id", "certs")

    def linked(self, cert_id: int) -> int | None:
        """The certificate of a precertificate or the other way round; None if not known.

        A recorded delta base comes first: of a final its own, of a precertificate the lowest
        cert_id that names it. Else the nearest entry of the other type with the same issuance key
        within the window, the earliest first.
        """
        row = self.row(cert_id)
        if row["kind"] == "chain":
            return None
        if row["kind"] == "final" and row["delta_base_cert_id"] is not None:
            return row["delta_base_cert_id"]
        if row["kind"] == "precert":
            found = self.dataset.table("certs", self.snap).where(F.col("delta_base_cert_id") == cert_id).agg(F.min("cert_id")).first()[0]
            if found is not None:
                return found
        found = nearest_links(self.dataset.table("entries", self.snap), self.entries(cert_id), row["kind"]).first()
        return found["linked_id"] if found else None


def nearest_links(entries: DataFrame, mine: DataFrame, kind: str) -> DataFrame:
    """cert_id and linked_id: for each certificate in mine the first entry of the other type with its issuance key in the window."""
    other = "x509" if kind == "precert" else "precert"
    mine = mine.where(F.col("issuance_key").isNotNull()).select("cert_id", "issuance_key", F.col("ct_ts").alias("at"))
    theirs = entries.where((F.col("entry_type") == other) & F.col("cert_id").isNotNull()).select("issuance_key", F.col("cert_id").alias("other_id"), "ct_ts")
    window = F.expr(LINK_WINDOW)
    near = F.col("ct_ts").between(F.col("at") - window, F.col("at") + window)
    hits = mine.join(theirs, "issuance_key").where(near & (F.col("other_id") != F.col("cert_id")))
    return hits.groupBy("cert_id").agg(F.min(F.struct("ct_ts", "other_id")).alias("f")).select("cert_id", F.col("f.other_id").alias("linked_id"))
