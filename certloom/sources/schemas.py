"""Declared schemas of all tables, and their versions."""

from __future__ import annotations

import hashlib

RAW = "log string, idx bigint, leaf_input binary, extra_data binary"
ENTRIES = (
    "idx bigint, ct_ts timestamp_ntz, entry_type string, cert_id bigint, leaf_hash binary, issuance_key binary, "
    "issuer_key_hash binary, chain_id binary, leaf_error string"
)
CHAINS = "chain_id binary, position int, cert_id bigint"
VAULT = "cert_id bigint, sha256 binary, der binary, delta_base_cert_id bigint"
QUARANTINE = "idx bigint, leaf_error string, leaf_input binary, extra_data binary"

# The published tables, columns in order. The location columns of a record store
# are kept for readers of the published layout; here they are null, as bytes lie in `vault`.
DERIVED = {
    ("certs", 1): (
        "cert_id bigint, sha256 string, kind string, has_ct_poison boolean, vault_seg bigint, vault_off bigint, vault_len bigint, "
        "delta_base_cert_id bigint, parse_status string, parse_errors array<string>, serial string, issuer_dn string, issuer_o string, "
        "issuer_cn string, issuer_der string, authority_key_id string, not_before timestamp_ntz, not_after timestamp_ntz, key_alg string, "
        "key_bits int, key_curve string, spki_alg_oid string, sig_alg string, subject_cn string, n_dns_names int, n_ip_names int, "
        "has_wildcard boolean, subject_key_id string, subject_der string"
    ),
    ("names", 1): "cert_id bigint, source string, name string, dns_valid boolean, is_wildcard boolean, tld string, etld1 string",
    ("cert_extensions", 1): "cert_id bigint, position bigint, oid string, critical boolean, length bigint, decode_error string",
    ("cert_policies", 1): "cert_id bigint, position bigint, policy_oid string, validation string, cps_uri string, n_qualifiers bigint",
    ("cert_ekus", 1): "cert_id bigint, position bigint, eku_oid string, eku_name string",
    ("cert_key_usage", 1): (
        "cert_id bigint, digital_signature boolean, content_commitment boolean, key_encipherment boolean, data_encipherment boolean, "
        "key_agreement boolean, key_cert_sign boolean, crl_sign boolean, encipher_only boolean, decipher_only boolean, is_ca boolean, path_len int"
    ),
    ("cert_aia", 1): "cert_id bigint, position bigint, method string, uri string",
    ("cert_crl_dps", 1): "cert_id bigint, dp_index bigint, uri string, has_reasons boolean, has_crl_issuer boolean",
    ("cert_scts", 1): "cert_id bigint, position bigint, version int, log_id string, timestamp timestamp_ntz, hash_alg int, sig_alg int",
}
TABLES = tuple(name for name, _ in DERIVED)
SOURCE = {"entries": ENTRIES, "chains": CHAINS, "vault": VAULT, "quarantine": QUARANTINE}


def columns(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of a schema."""
    return [tuple(c.strip().split(" ", 1)) for c in ddl.split(",")]


def schema_hash(ddl: str) -> str:
    return hashlib.sha256("".join(f"{n} {t}\n" for n, t in columns(ddl)).encode()).hexdigest()


def ddl_of(table: str, version: int | None = None) -> str:
    if table in SOURCE:
        return SOURCE[table]
    versions = [v for name, v in DERIVED if name == table]
    return DERIVED[table, version or max(versions)]
