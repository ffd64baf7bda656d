"""Operations of a training-data pipeline, as Spark operators. Nothing outside this subpackage imports it."""
