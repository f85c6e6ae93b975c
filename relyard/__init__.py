"""relyard: model-release analytics as Spark jobs over whole tables and streams."""
