"""Social-audience and title analytics as Spark DataFrame operators."""
