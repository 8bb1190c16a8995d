"""Operators of a training-data pipeline over document and vector tables.

Nothing else in the library imports this subpackage. Each module holds one operator;
``queries`` registers one thin query per operator, ``oracle`` the SQL that can express it.
"""
