"""Column expressions for residue, element and secondary-structure codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldframe import constants as K


def lookup(table: dict, key: Column, default: object = None) -> Column:
    """Value of a fixed code table as a map literal (at most about two hundred entries)."""
    found = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def one_letter(res_name: Column) -> Column:
    return lookup(K.THREE_TO_ONE, res_name, "X")


def three_letter(aa: Column) -> Column:
    return lookup(K.ONE_TO_THREE, aa, "UNK")


def ss_display(ss: Column) -> Column:
    """Eight states to three letters for display: helices H, strands E, anything else C."""
    return F.when(ss.isin("H", "G", "I"), "H").when(ss.isin("E", "B"), "E").otherwise("C")


def ss_cut(ss: Column) -> Column:
    """Eight states to the numbers used by the cut mask: 1 helix, 2 strand, 0 other."""
    return F.when(ss.isin("H", "G"), 1).when(ss.isin("E", "B"), 2).otherwise(0).cast("int")


def residue_class(res_name: Column) -> Column:
    """Kind of residue by its name."""
    return (F.when(res_name.isin(*K.AMINO_NAMES), "AMINO-ACID").when(res_name.isin(*K.RNA_NAMES), "RNA")
            .when(res_name.isin(*K.DNA_NAMES), "DNA").when(res_name.isin(*K.SOLVENT_NAMES), "SOLVENT").otherwise("HETERO"))


def element_of(atom_name: Column) -> Column:
    """Element of an atom name: first letter after leading digits."""
    return F.regexp_extract(atom_name, "^[0-9]*([A-Z])", 1)


def element_of_field(field: Column) -> Column:
    """Element of the four-column name field: two letters in the first two columns with nothing behind them are an element
    (``CA  `` is calcium, `` CA `` the alpha carbon)."""
    two = F.regexp_extract(field, "^([A-Z]{2}) *$", 1)
    return F.when(two != "", two).otherwise(element_of(F.trim(field)))


def chain_letter(rank: Column) -> Column:
    """1 gives A, 26 gives Z, 27 gives A1, 53 gives A2: every rank has a label of its own."""
    turn = F.floor((rank - 1) / 26).cast("int")
    return F.concat(F.char((F.lit(65) + (rank - 1) % 26).cast("int")), F.when(turn > 0, turn.cast("string")).otherwise(""))
