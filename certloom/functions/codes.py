"""The stable error codes of entries, certificates and extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Published codes, in the order of their families' registries.
ENTRY = {
    "leaf_bad_version": "The leaf's version is not 0, so no certificate is read from it.",
    "leaf_bad_leaf_type": "The leaf is not a timestamped entry, so no certificate is read from it.",
    "leaf_unknown_entry_type": "The entry is neither a certificate nor a precertificate.",
    "leaf_truncated": "The leaf input is shorter than its fields say.",
    "leaf_trailing_bytes": "The leaf input goes on after its last field.",
    "extra_truncated": "The extra data is shorter than its fields say; no chain is kept.",
    "extra_trailing_bytes": "The extra data goes on after the chain; no chain is kept.",
    "chain_cert_empty": "A certificate of the extra data has no bytes; no chain is kept.",
    "chain_issuer_missing": "The chain has no certificate that can have issued the precertificate.",
    "chain_issuer_ambiguous": "The chain has different certificates that can have issued the precertificate.",
    "issuer_key_hash_mismatch": "The hash of the issuer's public key is not the one in the leaf.",
    "precert_tbs_mismatch": "The precertificate without its poison is not what the leaf holds.",
    "issuance_key_unavailable": "The key that links precertificate and certificate cannot be computed.",
    "leaf_index_mismatch": "A tiled log's entry does not name its own position once.",
}
CERTIFICATE = {
    "cert_unreadable": "Not a sequence with a TBSCertificate; nothing is read and the status is failed.",
    "cert_trailing_data": "More bytes follow the certificate; they are ignored.",
    "signature_unreadable": "The outer algorithm or the signature value cannot be read.",
    "tbs_unreadable": "The six fixed fields cannot be found; the status is failed.",
    "tbs_extra_fields": "Unknown elements stand among the TBSCertificate's fields; they are ignored.",
    "version_bad": "The version is unreadable or not v1, v2 or v3.",
    "serial_unreadable": "The serial number is not an integer.",
    "serial_negative": "The serial number is below zero; its bytes are kept.",
    "serial_zero": "The serial number is zero.",
    "serial_too_long": "The serial number has more than 20 bytes; all are kept.",
    "serial_not_minimal": "The serial number has a needless leading byte; its bytes are kept.",
    "sig_alg_unreadable": "The signature algorithm cannot be read.",
    "sig_alg_mismatch": "Inner and outer signature algorithm differ.",
    "issuer_unreadable": "The issuer is not a Name.",
    "subject_unreadable": "The subject is not a Name.",
    "name_bad_string": "A name has bytes that its string type does not allow; they show as \\XX.",
    "validity_unreadable": "The validity is not a pair of times.",
    "time_bad_format": "A validity time is malformed; it is null.",
    "spki_unreadable": "The public key info cannot be read.",
    "key_unreadable": "The public key does not fit its algorithm; size or curve are missing.",
    "extensions_unreadable": "The list of extensions breaks off or cannot be read.",
    "ext_unreadable": "An extension is malformed and left out, or its value is not what it must be.",
    "ext_duplicate": "An extension comes twice; the first one counts.",
    "san_unreadable": "The alternative names cannot be read; none is taken.",
    "san_ip_bad_len": "An address among the alternative names is not 4 or 16 bytes; it shows as hex.",
    "san_dns_bad_string": "A DNS name among the alternative names has bytes outside ASCII.",
    "aki_unreadable": "The authority key identifier cannot be read.",
    "ski_unreadable": "The subject key identifier cannot be read.",
}
EXTENSION = {
    "ext_policies_malformed": "The policies cannot be decoded whole; they give no rows.",
    "ext_eku_malformed": "The extended key usages cannot be decoded whole; they give no rows.",
    "ext_key_usage_malformed": "The key usage is not a bit string; its columns are null.",
    "ext_basic_constraints_malformed": "The basic constraints cannot be decoded whole; their columns are null.",
    "ext_aia_malformed": "The authority information access cannot be decoded whole; it gives no rows.",
    "ext_crl_dps_malformed": "The CRL distribution points cannot be decoded whole; they give no rows.",
    "ext_sct_list_malformed": "The list of signed timestamps is framed wrongly; it gives no rows.",
    "ext_duplicate": "A decoded extension comes again; only its first copy is decoded.",
}
FAMILIES = {"entry": ENTRY, "certificate": CERTIFICATE, "extension": EXTENSION}
#: Entries with one of these have no certificate.
NO_CERTIFICATE = ("leaf_bad_version", "leaf_bad_leaf_type", "leaf_unknown_entry_type", "leaf_truncated", "leaf_trailing_bytes")


def explain(code: str) -> list[tuple[str, str]]:
    """(family, explanation) of a code in every family that has it."""
    return [(family, codes[code]) for family, codes in FAMILIES.items() if code in codes]


def codes_table(spark: SparkSession) -> DataFrame:
    rows = [(family, code, text) for family, codes in FAMILIES.items() for code, text in codes.items()]
    return spark.createDataFrame(rows, "family string, code string, explanation string")
