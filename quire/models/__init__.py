"""Chat and embedding models as plug-ins, with offline stand-ins."""
