"""Joins, scans and folds that stay bounded per task when one key is hot."""
