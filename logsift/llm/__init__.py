"""Operators for preparing training corpora.

Each module is one operator with its own DataFrame interface; ``queries``
applies them to whole tables. Nothing outside this package imports it.
"""
