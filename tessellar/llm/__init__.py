"""Operations of a training-data pipeline on documents, at corpus scale."""
