"""Operations of a training-data pipeline; nothing else in lexengine imports this subpackage."""
