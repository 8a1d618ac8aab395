"""Sources: parquet tables, LibSVM, labelled CSV, and the hash split."""

from multisvm.sources.tables import (
    labelled, embeddings, lineitem, part, from_columns, read_table, table_path, is_vector, vector_width, dense_array,
    ID, LABEL, FEATURES,
)
from multisvm.sources.split import with_split, train_test_split, random_split, SPLIT
from multisvm.sources.libsvm import read_libsvm, write_libsvm
from multisvm.sources.csv import read_labeled_csv, write_labeled_csv

__all__ = [
    "labelled", "embeddings", "lineitem", "part", "from_columns", "is_vector", "vector_width", "dense_array", "read_table", "table_path", "ID", "LABEL", "FEATURES",
    "with_split", "train_test_split", "random_split", "SPLIT",
    "read_libsvm", "write_libsvm", "read_labeled_csv", "write_labeled_csv",
]
