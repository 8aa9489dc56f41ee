"""Multi-sense word embeddings and vector-table analytics on PySpark DataFrames."""

from polysense.config import TrainConfig

__all__ = ["TrainConfig"]
