"""Operations of a training-data pipeline over a corpus of documents."""
