"""Operations of a training-data pipeline over tables of documents and vectors. Nothing else in the library imports it."""
