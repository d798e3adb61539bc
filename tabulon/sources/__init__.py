"""Storage: versioned tables behind a manifest, key/value buckets, codecs."""
