"""Queries bound to the tables, with the DuckDB SQL that checks them."""
