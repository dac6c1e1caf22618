"""Operations of a training-data pipeline, built on Spark; nothing else in the library imports them."""
