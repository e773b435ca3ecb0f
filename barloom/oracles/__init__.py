"""DuckDB SQL that states the registered queries independently."""
