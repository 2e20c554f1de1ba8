"""Where tables come from: the driver tables (``fixture``) and the raw-file layouts (``raw_files``)."""
