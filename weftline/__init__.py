"""weftline: structured recall over facts, links and time, as Spark plans."""

__version__ = "0.1.0"
