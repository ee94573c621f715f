"""Operators for preparing training text (one module per operator).

Nothing else in the library imports this subpackage. ``llm.keys`` registers
the ``opN_<name>`` queries; the operators keep their own general interfaces.
"""
