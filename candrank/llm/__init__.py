"""Operations a training-data pipeline needs, over tables of documents and pages."""
