"""Binary logs and manifests: byte formats, and DataFrames of them."""
