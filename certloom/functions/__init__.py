"""Scalar functions: DER, certificates, names, hashes and their Spark wrappers."""
