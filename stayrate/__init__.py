"""SaaS growth, retention and churn analytics as Spark DataFrame operators."""

from stayrate.params import Params
from stayrate.roles import Roles

__all__ = ["Params", "Roles"]
