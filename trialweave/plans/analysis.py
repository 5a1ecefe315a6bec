"""The after-study analysis as one plan over many studies."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.config import AnalysisConfig
from trialweave.functions.matrix import inverse
from trialweave.operators import bread as bread_ops
from trialweave.operators import checks as check_ops
from trialweave.operators import conditioning
from trialweave.operators import derivatives as derivative_ops
from trialweave.operators import frame as frame_ops
from trialweave.operators import rows as row_ops
from trialweave.operators import sandwich as sandwich_ops
from trialweave.operators import stack as stack_ops
from trialweave.operators import sums as sums_ops
from trialweave.operators.decisions import decisions, place
from trialweave.session import written


@dataclass(frozen=True)
class Analysis:
    """Lazily built tables of one analysis.

    ``log`` is a standardised decision log. Without ``policy_params`` the betas are estimated
    from the log by the update model. Only tables with a few rows per study are written between
    the passes over the log; everything per decision and per subject stays in one pipeline.
    """

    log: DataFrame
    config: AnalysisConfig
    policy_params: DataFrame | None = None
    # A written calendar with betas, where the caller has one already.
    known_frame: DataFrame | None = None

    @cached_property
    def _calendar(self) -> DataFrame:
        return written(frame_ops.study_frame(self.log), "calendar")

    @cached_property
    def estimated_params(self) -> DataFrame:
        """Betas by ridge least squares on all data before each update."""
        model = self.config.update
        placed = place(self.log, self._calendar)
        sums = sums_ops.update_sums(placed, model, "action_prob")
        statistics = sums_ops.cumulative_update_sums(sums, self._calendar, model)
        return sums_ops.solve_updates(statistics, model.ridge)

    @cached_property
    def params(self) -> DataFrame:
        return self.policy_params if self.policy_params is not None else self.estimated_params

    @cached_property
    def _beta_frame(self) -> DataFrame:
        """Calendar and betas in one write when the betas are given."""
        if self.known_frame is not None:
            return self.known_frame
        estimated = self.policy_params is None
        calendar = self._calendar if estimated else frame_ops.study_frame(self.log)
        frame = frame_ops.with_betas(calendar, self.params)
        if self.config.update.ridge or "n_users" in self.config.policy.carry:
            users = sums_ops.contributor_counts(self.log, calendar)
            frame = frame.join(users, "study_id", "left")
        else:
            frame = frame.withColumn("n_users", F.lit(None).cast("array<bigint>"))
        return written(frame, "betas")

    @cached_property
    def decided(self) -> DataFrame:
        return decisions(self.log, self._beta_frame, self.config)

    @cached_property
    def sums(self) -> DataFrame:
        return written(sums_ops.study_sums(self.decided, self.config), "sums")

    @cached_property
    def frame(self) -> DataFrame:
        """The study frame with betas, theta, and the derivative of the theta function."""
        theta = sums_ops.estimate_theta(self.sums, self.config)
        scale = F.lit(2.0) / F.col("n_subjects")
        full = self._beta_frame.join(theta, "study_id", "left").withColumn(
            "bread_inverse", F.transform("xx", lambda v: v * scale)
        )
        return written(full.drop("xx").withColumn("bread", inverse("bread_inverse")), "frame")

    @cached_property
    def digest(self) -> DataFrame:
        return stack_ops.subject_digest(self.decided, self.config)

    @cached_property
    def stack(self) -> DataFrame:
        return stack_ops.stack_rows(self.digest, self.frame, self.config)

    @cached_property
    def weighted_stack(self) -> DataFrame:
        return sandwich_ops.with_weights(self.stack, self.frame, self.config)

    @cached_property
    def stack_mean(self) -> DataFrame:
        return stack_ops.stack_mean(self.stack, self.frame)

    @cached_property
    def products(self) -> DataFrame:
        return written(bread_ops.digest_products(self.digest, self.frame, self.config), "products")

    @cached_property
    def bread_inverse(self) -> DataFrame:
        return bread_ops.bread_cells(self.products, self.sums, self.frame, self.config)

    @cached_property
    def meat(self) -> DataFrame:
        return bread_ops.meat_cells(self.products)

    @cached_property
    def joint(self) -> DataFrame:
        cells = sandwich_ops.joint_input(self.bread_inverse, self.meat, self.frame)
        return sandwich_ops.adjusted_variance(cells, self.config)

    @cached_property
    def classical(self) -> DataFrame:
        """Classical variance; the theta block of the joint meat is the classical meat."""
        q = self.config.inference.dim
        corner = (
            self.meat.join(self.frame.select("study_id", "n_updates"), "study_id")
            .filter("row_block = n_updates and col_block = n_updates")
            .groupBy("study_id")
            .agg(F.array_sort(F.collect_list(F.struct("r", "c", "value"))).alias("cells"))
            .select("study_id", F.transform("cells", lambda s: s["value"]).alias("meat"))
            .filter(F.size("meat") == q * q)
        )
        return sandwich_ops.classical_variance(corner, self.frame, self.config)

    @cached_property
    def checks(self) -> DataFrame:
        """Findings of all checks of the log, the inputs, the updates, the betas and the mean stack."""
        return self.findings(self.stack_mean)

    def findings(self, stack_mean: DataFrame) -> DataFrame:
        inputs = row_ops.policy_inputs(self.log, self.params, self.config.policy)
        updates = row_ops.update_rows(self.log, self._calendar, self.config.update)
        found = check_ops.check_everything(
            self.log, inputs, updates, self.decided, self._calendar, self.config
        )
        betas = check_ops.policies_have_betas(self._beta_frame, self.config.update.dim)
        stack = check_ops.mean_stack_check(stack_mean)
        return written(found.unionByName(betas).unionByName(stack), "checks")

    @cached_property
    def function_checks(self) -> DataFrame:
        """Estimating functions agree between recorded and recomputed probabilities."""
        update, inference = self.config.update, self.config.inference
        rows = row_ops.update_rows(self.log, self._calendar, update)
        keys = ["study_id", "policy_num", "subject_id"]

        def agreement(given: DataFrame, params: DataFrame, model, tolerances, name: str) -> DataFrame:
            again = derivative_ops.update_functions(row_ops.with_recomputed(given, self.decided), params, model)
            return check_ops.function_agreement(
                derivative_ops.update_functions(given, params, model), again, keys, tolerances, name)

        data, theta = derivative_ops.inference_rows(self.log, self.frame, inference)
        return agreement(
            rows, self.params, update, check_ops.UPDATE_FUNCTION_TOLERANCES, "update_functions_agree"
        ).unionByName(agreement(
            data, theta, inference, check_ops.INFERENCE_FUNCTION_TOLERANCES, "inference_functions_agree"))

    @cached_property
    def result_checks(self) -> DataFrame:
        """Checks of the joint matrices, and of the explicit variance where it is asked for."""
        out = check_ops.identity_check(self.joint)
        if self.config.explicit_adjustments:
            out = out.unionByName(check_ops.variance_agreement(self.explicit, self.joint))
        return out

    @cached_property
    def explicit(self) -> DataFrame:
        """(study_id, theta_only_variance): variance from explicit adjustments of every subject."""
        return written(conditioning.theta_only_variance(self.stack, self.bread_inverse, self.frame, self.config), "explicit")

    @cached_property
    def features(self) -> DataFrame:
        """Features of every study, where the configuration collects them."""
        from trialweave.operators.features import study_features

        if not self.config.collect_features:
            raise ValueError("collect_features is off")
        return study_features(self)

    def checked(self) -> Analysis:
        """The same analysis, once its checks have run; errors raise unless they are suppressed.

        Notes on unusual choices of the configuration are given as warnings.
        """
        self.config.advise()
        if not self.config.suppress_checks:
            check_ops.raise_on_errors(self.checks.unionByName(self.function_checks).unionByName(self.result_checks))
        return self

    @cached_property
    def result(self) -> DataFrame:
        """One row per study: theta and both variances, row-major.

        A study that cannot be analysed keeps its row, with null variances and a ``reason``.
        """
        b = self.config.update.dim
        usable = F.forall("betas", lambda v: F.coalesce(
            (F.size(v) == b) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))),
            F.lit(False),
        ))
        reason = (
            F.when(F.col("initial_policy").isNull(), "no_active_decisions")
            .when(~usable, "learned_policy_without_finite_beta")
            .when(F.col("theta").isNull(), "theta_not_solvable")
            .otherwise(F.col("reason"))
        )
        explicit = ["theta_only_variance"] if self.config.explicit_adjustments else []
        joint = self.joint.drop("n_updates")
        if explicit:
            joint = joint.join(self.explicit, "study_id", "left")
        shown = lambda c: F.when(F.col("why").isNull(), F.col(c)).alias(c)
        return (
            self.frame.select("study_id", "n_subjects", "n_updates", "theta", "betas", "initial_policy")
            .join(joint, "study_id", "left")
            .join(self.classical, "study_id", "left")
            .withColumn("why", reason)
            .select(
                "study_id", "n_subjects", "n_updates", "theta", shown("adjusted_variance"),
                shown("classical_variance"), shown("joint_condition"), shown("negative_variances"),
                *map(shown, explicit), F.col("why").alias("reason"),
            )
        )
