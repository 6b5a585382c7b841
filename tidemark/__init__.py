"""tidemark: drift analytics over windowed text streams, written as Spark DataFrame operators."""
