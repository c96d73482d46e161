"""Recipes and the query catalogue; importing the package registers every survey query."""

from . import catalogue, fieldwork, files, finishing, whole

__all__ = ["catalogue", "fieldwork", "files", "finishing", "whole"]
