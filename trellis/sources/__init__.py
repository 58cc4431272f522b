from trellis.sources.tables import table

__all__ = ["table"]
