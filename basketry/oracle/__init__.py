"""Independent DuckDB SQL for every registered operator (the test oracle)."""
