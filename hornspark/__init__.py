"""Horn-rule grounding over knowledge graphs, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
