"""Independent DuckDB SQL oracles for the Spark jobs."""
