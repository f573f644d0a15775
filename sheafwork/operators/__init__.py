"""Operators: DataFrame in, DataFrame out; none runs an action unless its docstring says so."""
